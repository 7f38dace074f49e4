"""Tables that take upserts: immutable data folders, numbered manifests, merge on read and compaction.

A version is one manifest, a small file that names a base folder and the delta
folders on top of it, in order.  An upsert writes its rows as a new delta, then
the next manifest; the newest manifest is the table.  A writer that stops in
between leaves a folder that no manifest names: readers never see it, and
``vacuum`` deletes it.  Manifests are made only if their number is free, so of
two writers one comes second and takes the next number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..files import Exists, Files
from ..staging import checked_broadcast

#: Deltas of a table at most before an upsert compacts it.
MOST_DELTAS = 16
_LAYER, _GONE = "_layer", "_gone"


class Conflict(RuntimeError):
    """The table has changed since it was read."""


class VersionedTable:
    """A table below ``root`` whose rows go by ``keys``: a new row replaces all older ones that share *any* of its keys.

    A null key matches nothing.  Rows of one upsert don't replace each other.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.keys, self.files = spark, keys, Files(spark, root)
        self.root = root.rstrip("/")

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return [int(n.partition(".")[0]) for n in self.files.names("manifests")]

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "base": None, "deltas": [], "schema": None}
        return json.loads(self.files.read(f"manifests/{known[-1] if version is None else version:010d}.json"))

    def _commit(self, manifest: dict) -> int:
        try:
            self.files.create(f"manifests/{manifest['version']:010d}.json", json.dumps(manifest))
        except Exists as e:
            raise Conflict(f"version {manifest['version']} was made by another writer") from e
        return manifest["version"]

    def _folder(self, rows: DataFrame, kind: str) -> str:
        name = f"data/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    # ------------------------------------------------------------ writing

    def replace(self, rows: DataFrame) -> int:
        """The whole table anew; the version made.  ``rows`` may be made from the table itself."""
        before = self.manifest()
        base = self._folder(rows, "base")
        return self._commit({"version": before["version"] + 1, "base": base, "deltas": [], "schema": rows.schema.json()})

    def upsert(self, rows: DataFrame, gone: bool = False, most: int = MOST_DELTAS) -> int:
        """Add ``rows`` in place of older ones with one of their keys (``gone``: only take those away); the version made."""
        before = self.manifest()
        if before["schema"] is None:
            raise LookupError(f"no table below {self.root}")
        columns = json.loads(before["schema"])["fields"]
        # A deletion need not hold more than keys; nulls keep files of one table alike.
        have = set(rows.columns)
        even = rows.select(*[(F.col(f"`{f['name']}`") if f["name"] in have else F.lit(None)).alias(f["name"]) for f in columns])
        schema = self._schema(before)
        even = even.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        delta = self._folder(even.withColumn(_GONE, F.lit(gone)), "delta")
        while True:
            now = self.manifest()
            try:
                made = self._commit({**now, "version": now["version"] + 1, "deltas": [*now["deltas"], delta]})
                break
            except Conflict:
                continue  # the delta goes on top of what the other writer has made
        if len(now["deltas"]) + 1 >= most:
            try:
                return self.compact()
            except Conflict:
                pass  # the next one will
        return made

    def compact(self) -> int:
        """Base and deltas as one new base; ``Conflict`` if an upsert came in between."""
        now = self.manifest()
        if not now["deltas"]:
            return now["version"]
        base = self._folder(self.read(now["version"]), "base")
        return self._commit({**now, "version": now["version"] + 1, "base": base, "deltas": []})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete manifests but the newest ``keep``, and folders that none of those names; what went.  Not while others write."""
        known = self.versions()
        for v in known[:-keep]:
            self.files.delete(f"manifests/{v:010d}.json")
        used = {f for v in known[-keep:] for m in [self.manifest(v)] for f in (m["base"], *m["deltas"])}
        lost = [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in used]
        for name in lost:
            self.files.delete(name)
        return lost

    # ------------------------------------------------------------ reading

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest): deltas over the base, later ones first.

        Base rows meet only the deltas' keys; the deltas are ranked by key.
        """
        m = self.manifest(version)
        if m["schema"] is None:
            raise LookupError(f"no table below {self.root}")
        schema = self._schema(m)
        base = self.spark.read.schema(schema).parquet(f"{self.root}/{m['base']}")
        if not m["deltas"]:
            return base
        layered = schema.add(_GONE, "boolean")
        layers = [self.spark.read.schema(layered).parquet(f"{self.root}/{d}").withColumn(_LAYER, F.lit(i)) for i, d in enumerate(m["deltas"])]
        deltas = layers[0]
        for layer in layers[1:]:
            deltas = deltas.unionByName(layer)
        # Marked by every key before any row goes: what a later row replaces, it replaces for good.
        old = F.lit(False)
        live = deltas
        for i, key in enumerate(self.keys):
            known = deltas.select(F.col(key).alias("_k")).where("_k is not null").distinct()
            base = base.join(checked_broadcast(known), F.col(key) == F.col("_k"), "left_anti")
            live = live.withColumn(f"_newest{i}", F.max(_LAYER).over(W.partitionBy(key)))
            old = old | (F.col(key).isNotNull() & (F.col(f"_newest{i}") > F.col(_LAYER)))
        live = live.where(~old)
        return base.unionByName(live.where(f"not {_GONE}").select(*base.columns))
