"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset: the session's checkpoint folder, else the warehouse on
    a cluster, else (one machine only, as in tests) a temporary folder.
    """
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.getCheckpointDir().isDefined():
            found = context.getCheckpointDir().get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="garimpo-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/garimpo-staged"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of this process's staged tables, by application.
_staged: dict[str, list[str]] = {}


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` will delete."""
    path = f"{shared_dir(spark)}/garimpo-{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the staged tables of this application; how many went.

    Results that were not written or collected yet can't be read afterwards.
    """
    jvm, paths = spark.sparkContext._jvm, _staged.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers up to which a side of a join is broadcast; beyond, both sides shuffle.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df`` (staged, narrow) marked for broadcast if it is small enough: wide rows then needn't shuffle to meet it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
