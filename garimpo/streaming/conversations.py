"""Conversation memory and audit events as append-only tables, readable as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "ts timestamp, event string, client_ip string, method string, path string, details map<string,string>"


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT).json(path)


def events_by_window(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; late rows are waited for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event").agg(F.count("*").alias("n"))


def remembered(turns: DataFrame, answered: DataFrame) -> DataFrame:
    """Conversations with a question and its answer appended, where the answer isn't empty."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    new = answered.where("answer <> ''").join(last, "conv_id", "left").withColumn("at", F.coalesce("last", F.lit(-1)))
    pair = F.explode(F.array(F.struct((F.col("at") + 1).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((F.col("at") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))))
    return turns.select("conv_id", "turn", "role", "text").unionByName(new.select("conv_id", pair.alias("p")).select("conv_id", F.col("p.turn").cast("long").alias("turn"), "p.role", "p.text"))
