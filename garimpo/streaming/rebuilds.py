"""Index rebuilds as a stream job: requests are files, a run works off what is there, in order, and ends.

Every finished stage of a run leaves a marker before the next one starts.  A job
that stops in mid-run is given the same batch again by the stream's checkpoint,
and goes on behind the last marker: nothing that was finished is repeated.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Files

REQUEST = "run string, reason string"
STARTED, QUEUED = 200, 409


class Rebuilds:
    """A queue of rebuilds below ``root`` with named ``stages``, worked off by one job at a time."""

    def __init__(self, spark: SparkSession, root: str, stages: list[tuple[str, Callable[[str], object]]]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages
        self.files = Files(spark, root)

    def enqueue(self, reason: str = "") -> dict:
        """Ask for a rebuild: (run, status, code, position).  200 where none was waiting, else 409 and it waits its turn."""
        waiting = len(self.pending())
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.files.create(f"requests/{run}.json", json.dumps({"run": run, "reason": reason}))
        return {"run": run, "status": "queued" if waiting else "started", "code": QUEUED if waiting else STARTED, "position": waiting + 1}

    def pending(self) -> list[str]:
        """Runs that are asked for and not finished, oldest first."""
        done = {n for n in self.files.names("ledger") if self.files.exists(f"ledger/{n}/end.json")}
        return [n.removesuffix(".json") for n in self.files.names("requests") if n.removesuffix(".json") not in done]

    def work(self, timeout: float | None = None) -> None:
        """Work off all requests that are there, then end (for a scheduler to call); raises what stopped it."""
        if not self.files.names("requests"):
            return
        asked = self.spark.readStream.schema(REQUEST).json(f"{self.root}/requests")
        job = asked.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        job.awaitTermination(timeout) if timeout else job.awaitTermination()

    def _batch(self, requests: DataFrame, batch: int) -> None:
        for r in requests.orderBy("run").collect():  # one row a request
            if not self.files.exists(f"ledger/{r.run}/end.json"):
                self._run(r.run, batch)

    def _run(self, run: str, batch: int) -> None:
        error = None
        for number, (name, stage) in enumerate(self.stages):
            marker = f"ledger/{run}/{number:03d}-{name}.json"
            if self.files.exists(marker):
                continue
            began = time.monotonic()
            try:
                stage(run)
            except Exception as e:  # the run has failed; the queue goes on
                error = f"{name}: {e}"
                break
            self.files.create(marker, json.dumps({"run": run, "stage": name, "batch": batch, "event": "complete", "seconds": time.monotonic() - began}))
        self.files.create(f"ledger/{run}/end.json", json.dumps({"run": run, "batch": batch, "event": "fail" if error else "complete", "error": error}))

    def events(self) -> DataFrame:
        """(run, stage, batch, event, error, seconds) of all finished stages and runs (those without a stage)."""
        return self.spark.read.schema("run string, stage string, batch long, event string, error string, seconds double").option("recursiveFileLookup", True).json(f"{self.root}/ledger")

    def snapshot(self) -> dict:
        """How many wait, and how many have completed or failed."""
        counts = {"complete": 0, "fail": 0}
        if self.files.exists("ledger"):
            counts |= {r.event: r["count"] for r in self.events().where(F.col("stage").isNull()).groupBy("event").count().collect()}
        return {"queued": len(self.pending()), "completed": counts["complete"], "failed": counts["fail"]}
