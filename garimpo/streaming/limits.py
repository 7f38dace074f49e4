"""Sliding-window rate limiting: state is the accepted requests only."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION = "client string, ts timestamp, request_id long, accepted boolean"


def decide(times: list[float], window: float, limit: int, held: deque | None = None) -> tuple[list[bool], deque]:
    """Which of the requests (in time order) are accepted; rejected ones leave no trace."""
    held = deque() if held is None else held
    out = []
    for t in times:
        while held and t - held[0] > window:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, held


def _rows(batches: Iterator[pd.DataFrame], window: float, limit: int) -> Iterator[pd.DataFrame]:
    client, held = None, deque()
    for b in batches:
        accepted = []
        for name, t in zip(b["client"], b["ts"].astype("int64") / 1e9, strict=True):
            if name != client:
                client, held = name, deque()
            one, held = decide([t], window, limit, held)
            accepted += one
        yield b.assign(accepted=accepted)


def rate_limit(requests: DataFrame, window: float = 60.0, limit: int = 120) -> DataFrame:
    """Decisions over ``requests(client, ts, request_id)``.

    Each client's requests stream through a task in time order; a client's state
    is at most ``limit`` times, so a client with very many requests needs no more
    memory than any other.
    """
    ordered = requests.select(F.col("client").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("request_id").cast("long").alias("request_id")).repartition("client").sortWithinPartitions("client", "ts", "request_id")
    return ordered.mapInPandas(lambda batches: _rows(batches, window, limit), DECISION)


# Paths that need no key, and those that need the administrators'.
PUBLIC_PATHS = ("/", "/status", "/docs", "/redoc", "/openapi.json")
ADMIN_PATHS = ("/upload", "/upload-metadata", "/upload-legacy-disabled", "/reprocessar", "/recarregar")


def access(requests: DataFrame, read_key: str = "", admin_key: str = "", window: float = 60.0, limit: int = 120) -> DataFrame:
    """(request_id, code) of ``requests(client, ts, request_id, method, path, key)``.

    Public paths, the web pages and OPTIONS pass uncounted.  Administrators'
    paths take the admin key alone (403 for another one, or where only a read
    key is set), all others either key; 401 for a missing or wrong one.  Where no
    key is set, none is asked for.  What passes is counted by client: 429 over
    the limit.
    """
    path, key = F.col("path"), F.coalesce("key", F.lit(""))
    public = (F.col("method") == "OPTIONS") | path.isin(*PUBLIC_PATHS) | path.startswith("/web")
    admin = path.isin(*ADMIN_PATHS) | path.startswith("/admin/")
    is_admin = key == admin_key if admin_key else F.lit(False)
    is_any = key.isin(*[k for k in (read_key, admin_key) if k]) if read_key or admin_key else F.lit(True)
    if admin_key:
        code = F.when(admin & ~is_admin, F.when(key != "", 403).otherwise(401)).when(~admin & ~is_any, 401)
    else:
        code = F.when(admin & F.lit(bool(read_key)), 403).when(~admin & ~is_any, 401)
    judged = requests.select(F.coalesce(F.nullif("client", F.lit("")), F.lit("desconhecido")).alias("client"), "ts", "request_id", F.when(public, 200).otherwise(code).alias("code"))
    limited = rate_limit(judged.where("code is null"), window, limit).select("request_id", F.when(F.col("accepted"), 200).otherwise(429).alias("code"))
    return judged.where("code is not null").select("request_id", "code").unionByName(limited)


class Limiter(StatefulProcessor):
    """A client's accepted times as list state; a timer clears it once the watermark has passed the last one's window."""

    def __init__(self, window: float, limit: int):
        self.window, self.limit = window, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [(f["ts"].astype("datetime64[ns]").to_numpy(), f["request_id"].to_numpy()) for f in rows]
        ts, ids = (np.concatenate(x) for x in zip(*frames, strict=True))
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        held = deque(t for (t,) in self.held.get()) if self.held.exists() else deque()
        for at in range(0, len(ts), SENT_ROWS):  # decisions leave as they are made
            some = slice(at, at + SENT_ROWS)
            accepted, held = decide((ts[some].astype("int64") / 1e9).tolist(), self.window, self.limit, held)
            yield pd.DataFrame({"client": key[0], "ts": ts[some], "request_id": ids[some], "accepted": accepted})
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.held.put([(t,) for t in held])
            self.handle.registerTimer(math.ceil((held[-1] + self.window) * 1000) + 1)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


#: Decisions of a client that leave together.
SENT_ROWS = 10_000


def rate_limit_stream(requests: DataFrame, window: float = 60.0, limit: int = 120, late: str = "1 minute") -> DataFrame:
    """The same over a stream of ``requests(client, ts, request_id)``.

    State by client carries the accepted times from batch to batch.  Requests
    may come ``late``; later ones are dropped, as their window is closed.  When
    the watermark passes the end of a client's last window, nothing that can
    still come depends on its state, and a timer deletes it: clients that stay
    away cost nothing.  The session's state store is set to RocksDB, which
    this kind of state needs; a null client is a client.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("request_id").cast("long").alias("request_id"))
    return rows.withWatermark("ts", late).groupBy("client").transformWithStateInPandas(Limiter(window, limit), DECISION, "append", "EventTime")
