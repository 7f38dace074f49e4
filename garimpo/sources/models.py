"""Language and embedding models as injected callables; the local endpoint's checks."""

from __future__ import annotations

import ipaddress
import json
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prefixes that the embedding model expects of queries and passages.
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def is_loopback(host: str | None) -> bool:
    if not host:
        return False
    if host == "localhost":
        return True
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def checked_endpoint(url: str, allow_remote: bool = False) -> str:
    """The endpoint; only http(s), and only this machine unless remote ones are allowed."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not an HTTP endpoint: {url}")
    if not allow_remote and not is_loopback(parts.hostname):
        raise ValueError(f"not a local endpoint: {url}")
    return url.rstrip("/")


def checked_model(name: str, allowed) -> str:
    if name not in allowed:
        raise ValueError(f"model not allowed: {name}")
    return name


def available_models(allowed, fetch: Callable[[], list[str]] | None = None, url: str = "http://localhost:11434", timeout: float = 5) -> list[str]:
    """Allowed models that the server has; all allowed ones where it can't be asked or has none."""

    def ask() -> list[str]:
        with urllib.request.urlopen(f"{checked_endpoint(url)}/api/tags", timeout=timeout) as r:  # noqa: S310  checked above
            return [m.get("name", "") for m in json.load(r).get("models", [])]

    try:
        found = (fetch or ask)()
    except (OSError, ValueError):
        found = []
    return sorted(set(found) & set(allowed)) or sorted(allowed)


def generated(prompts: DataFrame, model: Callable[[list[str]], list[str | None]], batch: int = 32) -> DataFrame:
    """(query_id, answer) of ``prompts(query_id, prompt)``; a failed prompt has a null answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str | None] = []
            for at in range(0, len(f), batch):
                some = f["prompt"].iloc[at : at + batch].tolist()
                try:
                    out += model(some)
                except Exception:  # a model that fails leaves its prompts unanswered, for the extractive answer
                    out += [None] * len(some)
            yield pd.DataFrame({"query_id": f["query_id"], "answer": pd.Series(out, dtype=object, index=f.index)})

    return prompts.select(F.col("query_id").cast("long").alias("query_id"), "prompt").mapInPandas(run, "query_id long, answer string")


def evaluation_rows(chunks: DataFrame, model: Callable[[list[str]], list[str | None]], ask: str, n: int, seed: int = 0) -> DataFrame:
    """(question, ground_truth, context, documento, pagina, chunk_id): a question and its answer made from each of n sampled chunks.

    ``ask`` is the prompt's text before a chunk's.  The model's JSON may stand in
    code fences; answers that can't be read, or lack a question, drop out.
    """
    from ..functions.text import json_fenced_in
    from ..operators.library import useful_chunks

    some = useful_chunks(chunks, n, seed)
    said = generated(some.select(F.col("id").alias("query_id"), F.concat(F.lit(ask), "texto").alias("prompt")), model)
    read = said.select(F.col("query_id").alias("id"), json_fenced_in(F.col("answer"), "question string, ground_truth string").alias("a")).where("a.question is not null")
    return some.join(read, "id").select("a.question", "a.ground_truth", F.array("texto").alias("context"), "documento", "pagina", F.col("id").alias("chunk_id"))


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], dims: int, prefix: str = PASSAGE_PREFIX, batch: int = 32) -> DataFrame:
    """(id, vector) of ``texts(id, texto)``: unit vectors of the model's; another length fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list[list[float]] = []
            for at in range(0, len(f), batch):
                vectors += model([prefix + (t or "").strip() for t in f["texto"].iloc[at : at + batch]])
            for v in vectors:
                if len(v) != dims:
                    raise ValueError(f"vector has not {dims} dimensions but {len(v)}")
            norms = [sum(x * x for x in v) ** 0.5 or 1.0 for v in vectors]
            yield pd.DataFrame({"id": f["id"], "vector": [[x / n for x in v] for v, n in zip(vectors, norms, strict=True)]})

    return texts.select("id", "texto").mapInPandas(run, "id long, vector array<float>")
