"""Writers: chunk tables, index tables with a manifest, JSON lines and result files."""

from __future__ import annotations

import json
import logging
import secrets
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merkle


def chunk_tables(chunks: DataFrame, parents: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    parents.write.mode("overwrite").parquet(f"{path}/parents")


def index_tables(chunks: DataFrame, vectors: DataFrame, parents: DataFrame, path: str, model: str, dims: int) -> DataFrame:
    """Chunks, vectors and parents as tables, and a one-row manifest with counts and checksums.

    Each checksum is the root of a tree of SHA-256 digests over a table as it was
    written (see ``operators.merkle``); the trees lie beside it, so that a
    damaged copy can be traced to its rows.
    """
    chunk_tables(chunks, parents, path)
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = chunks.sparkSession
    roots = {}
    for name, key in (("chunks", "id"), ("vectors", "id"), ("parents", "parent_id")):
        nodes = merkle.tree(spark.read.parquet(f"{path}/{name}"), key)
        nodes.write.mode("overwrite").parquet(f"{path}/trees/{name}")
        roots[name] = merkle.root(spark.read.parquet(f"{path}/trees/{name}"))
    held = spark.read.parquet(f"{path}/chunks")
    names = {"chunks": "checksum", "vectors": "vectors_checksum", "parents": "parents_checksum"}
    manifest = held.agg(F.count("*").alias("total_chunks")).select("*", *[F.lit(roots[t]).alias(c) for t, c in names.items()], F.lit(model).alias("model_name"), F.lit(dims).alias("embedding_dim"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at_utc"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def structured_documents(documents: DataFrame, path: str) -> None:
    """``(documento, paginas)`` as structured payload files, one object with its version a file."""
    payload = documents.select(F.struct(F.lit(2).alias("versao"), F.array(F.struct("documento", "paginas")).alias("documentos")).alias("p"))
    payload.select("p.*").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def catalog_chunks(chunks: DataFrame, path: str) -> None:
    """The catalog's chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def audit_append(events: DataFrame, path: str) -> None:
    """Audit events as appended JSON lines."""
    events.write.mode("append").json(path)


def json_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as one JSON object, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def ordered(questions: DataFrame, key: str = "query_id") -> DataFrame:
    """Questions dealt out by ranges of their key and sorted within them: what is made of them row by row comes in order."""
    return questions.repartitionByRange(F.asc_nulls_first(key)).sortWithinPartitions(F.asc_nulls_first(key))


def deliver(events: DataFrame, column: str = "event"):
    """The lines of ``events``, one after the other, partition by partition.

    A partition is computed when the one before it is being read: the first
    line leaves before the last answer is made, and the driver holds two
    partitions at most.  Made of ``ordered`` questions, the lines are in order.
    """
    for row in events.select(column).toLocalIterator(prefetchPartitions=True):
        yield row[0]


def quarantined_name() -> str:
    """A random name for an upload, whatever it was called."""
    return f"{secrets.token_hex(16)}.pdf"


def approve_file(name: str, quarantine: str, approved: str) -> str:
    """Move a file out of quarantine on the driver's file system; its new path.  Names that lead elsewhere are refused."""
    clean = Path((name or "").strip()).name
    if Path(clean).suffix.lower() != ".pdf":
        raise ValueError("not the name of an approved file")
    source, target = (Path(root).resolve() / clean for root in (quarantine, approved))
    for path, root in ((source, quarantine), (target, approved)):
        if path.resolve().parent != Path(root).resolve():
            raise ValueError("path outside its folder")
    if not source.is_file():
        raise FileNotFoundError(clean)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(str(source), str(target))
    return str(target)


def record_event(spark, path: str, event: str, client_ip: str = "desconhecido", method: str | None = None, place: str | None = None, **details) -> None:
    """One audit event, appended to the audit table and logged."""
    facts = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in details.items()}
    row = spark.createDataFrame([(event, client_ip, method, place, facts)], "event string, client_ip string, method string, path string, details map<string,string>")
    audit_append(row.select(F.current_timestamp().alias("ts"), "*"), path)
    logging.getLogger("garimpo.audit").info("event=%s %s", event, " ".join(f"{k}={v}" for k, v in facts.items()))


def result_table(rows: DataFrame, path: str) -> None:
    """Per-question results (few rows) as one CSV file with a header, nested values as JSON."""
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in rows.schema.fields]
    rows.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def result_file(row: dict, path: str) -> None:
    """A small result (metrics) as one JSON file on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=2)
