"""q55's keys and ids on orders that the given tables have few of: numbers that begin with the year, negative ones, nulls."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.plans.catalog import ORACLE_SQL, QUERIES

NAME = "q55_document_keys"


def test_equals_its_sql(spark, tmp_path):
    numbers = [19988, 19989, 19990, 19991, 1998, 1997, 199800000, 5, 0, -1, -2, -3, -4, -1998, 1998, None, None, 2**62, -(2**63)]
    years = [1998, 1998, 1998, 1998, 1998, 1997, 1998, 2001, 1995, 1996, 1996, 1996, 1996, 1996, None, 1998, None, 1998, 1998]
    keys, dates = pa.array(numbers, pa.int64()), pa.array([y and datetime.datetime(y, 12, 31, 23, 59) for y in years], pa.timestamp("us"))
    pq.write_table(pa.table({"o_orderkey": keys, "o_orderdate": dates}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    want = sorted(con.sql(ORACLE_SQL[NAME]).fetchall(), key=str)
    got = QUERIES[NAME](spark, str(tmp_path)).select("o_orderkey", "key", "id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert (19988, "uploads/19988.pdf", "1998_19988") in want


def test_year_always_in_front(spark):
    row = spark.createDataFrame([("a/19988.pdf", 1998), ("2024 x.pdf", 2024), ("b.pdf", None)], "t string, y int")
    got = row.select(X.document_id("t", F.col("y")), X.document_id("t", F.col("y"), always=True)).collect()
    assert [tuple(r) for r in got] == [("19988", "1998_19988"), ("2024_x", "2024_2024_x"), ("b", "b")]
