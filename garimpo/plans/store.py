"""Index tables by collection: lazy, replaced as a whole; and a queue of rebuilds."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Public names of the domains and the collections behind them.
DOMAINS = {"documentos": "chunks", "solucoes": "solution_chunks"}


def collection_of(domain: str) -> str:
    if domain not in DOMAINS:
        raise ValueError(f"unknown retrieval domain: {domain}")
    return DOMAINS[domain]


class MissingIndex(LookupError):
    """A collection's tables aren't there."""


def metadata_path(root: str, collection: str, exists: Callable[[str], bool], legacy: str = "index/metadata.json") -> str:
    """Where a collection's index is described: its own folder, or (for the documents' alone) the old place."""
    own = f"{root}/{collection}/metadata.json"
    if exists(own):
        return own
    if collection == DOMAINS["documentos"] and exists(f"{root}/{legacy}"):
        return f"{root}/{legacy}"
    raise MissingIndex(f"no index of {collection} below {root}")


class Store:
    """Loads a collection's tables on first use; ``reload`` builds anew, then swaps."""

    def __init__(self, load: Callable[[str], dict[str, DataFrame]]):
        self._load, self._held, self._lock = load, {}, threading.RLock()

    def get(self, collection: str) -> dict[str, DataFrame]:
        with self._lock:
            if collection not in self._held:
                self._held[collection] = self._load(collection)
            return self._held[collection]

    def reload(self, collection: str) -> dict[str, DataFrame]:
        new = self._load(collection)
        with self._lock:
            self._held[collection] = new
        return new

    def health(self, collection: str, load: bool = False) -> dict:
        """Whether it is loaded, or why it can't be; loads only if asked to."""
        try:
            if load:
                self.get(collection)
            with self._lock:
                return {"status": "ok", "loaded": collection in self._held}
        except Exception as e:  # health reports, it doesn't raise
            return {"status": "degraded", "loaded": False, "error": str(e)}


def service_status(health: dict, chunks: DataFrame | None, models: Callable[[], list[str]], worker: dict, version: str = "") -> dict:
    """The service at a glance: the index's counts (0 where it isn't loaded), the model's server, the rebuild queue."""
    loaded = bool(health.get("loaded")) and chunks is not None
    total = areas = subjects = 0
    if loaded:
        from ..operators import library

        total, areas, subjects = chunks.count(), library.areas(chunks).count(), library.subjects(chunks).count()
    try:
        names, online = sorted(models()), True
    except Exception:  # a server that doesn't answer is offline
        names, online = [], False
    return {"status": "ok", "indice_carregado": loaded, "total_chunks": total, "areas_disponiveis": areas, "assuntos_disponiveis": subjects, "llm_online": online, "modelos_disponiveis": names, "versao_api": version, "rag_cache": health, "reprocessamento": worker}


def error_of(error: Exception) -> tuple[int, str]:
    """(status, message) of a failure: 503 for a missing index, 502 where a server can't be reached, else 500."""
    code = 503 if isinstance(error, (MissingIndex, FileNotFoundError)) else 502 if isinstance(error, (ConnectionError, TimeoutError)) else 500
    return code, str(error)


class Rebuilds:
    """One worker, first in first out; a failing run is recorded and the worker goes on."""

    def __init__(self, stages: list[tuple[str, Callable[[], object]]], on_event: Callable[[dict], None] = lambda e: None):
        self._stages, self._emit = stages, on_event
        self._queue: deque[int] = deque()
        self._lock, self._thread, self._next, self.completed, self.failed = threading.Condition(), None, 1, 0, 0

    def enqueue(self) -> dict:
        """``started`` where the worker was idle, else ``queued``."""
        with self._lock:
            run, self._next = self._next, self._next + 1
            idle = self._thread is None
            self._queue.append(run)
            if idle:
                self._thread = threading.Thread(target=self._work, daemon=True)
                self._thread.start()
            return {"run": run, "status": "started" if idle else "queued", "position": len(self._queue)}

    def _work(self) -> None:
        while True:
            with self._lock:
                if not self._queue:
                    self._thread = None
                    self._lock.notify_all()
                    return
                run = self._queue.popleft()
            try:
                for name, stage in self._stages:
                    began = time.monotonic()
                    self._emit({"run": run, "stage": name, "event": "start"})
                    try:
                        stage()
                    except Exception as e:
                        self._emit({"run": run, "stage": name, "event": "fail", "error": str(e), "seconds": time.monotonic() - began})
                        raise
                    self._emit({"run": run, "stage": name, "event": "complete", "seconds": time.monotonic() - began})
                self.completed += 1
            except Exception:  # reported by its event
                self.failed += 1

    def snapshot(self) -> dict:
        with self._lock:
            return {"running": self._thread is not None, "queued": len(self._queue), "completed": self.completed, "failed": self.failed}

    def wait(self, timeout: float = 60) -> bool:
        with self._lock:
            return self._lock.wait_for(lambda: self._thread is None, timeout)
