"""Settings that change results, passed explicitly; several can coexist in a session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Fixed values: (default, least, most) of each bounded setting.
BOUNDS = {
    "top_k": (5, 1, 20),
    "dense_candidates": (40, 5, 2000),
    "sparse_candidates": (80, 5, 5000),
    "rrf_k": (60, 1, 200),
    "min_dense_percent": (18, 0, 100),
    "max_chars_per_chunk": (700, 200, 4000),
    "max_context_chunks": (6, 1, 10),
    "reranker_candidates": (20, 3, 200),
    "reranker_top_n": (3, 1, 10),
}
TRUE_WORDS = ("1", "true", "yes", "on", "sim", "s")


def env_file(path: str, env=None) -> dict[str, str]:
    """Variables of a file of ``KEY=VALUE`` lines added to the environment; those that are set stay as they are.

    Blank lines, comments and lines without an equals sign are skipped; quotes
    around a value go.  No file adds nothing.
    """
    env, added = os.environ if env is None else env, {}
    if not os.path.exists(path):
        return added
    with open(path, encoding="utf-8") as f:
        for key, found, value in (line.strip().partition("=") for line in f if not line.lstrip().startswith("#")):
            key, value = key.strip(), value.strip()
            if found and key and key not in env:
                quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "'\""
                env[key] = added[key] = value[1:-1] if quoted else value
    return added


@dataclass(frozen=True)
class Options:
    top_k: int = 5
    dense_candidates: int = 40
    sparse_candidates: int = 80
    rrf_k: int = 60
    min_dense_percent: int = 18
    max_chars_per_chunk: int = 700
    max_context_chunks: int = 6
    reranker_candidates: int = 20
    reranker_top_n: int = 3
    query_planning: bool = False
    k1: float = 1.5
    b: float = 0.75
    child_words: int = 300
    child_overlap: int = 35
    parent_max_words: int = 900

    @property
    def min_dense(self) -> float:
        return self.min_dense_percent / 100

    @classmethod
    def from_env(cls, prefix: str = "", env=None) -> Options:
        """Values from environment variables; what isn't a number is the default, numbers are clamped."""
        env, values = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(f"{prefix}{f.name.upper()}")
            if raw is None:
                continue
            if f.name in BOUNDS:
                default, least, most = BOUNDS[f.name]
                try:
                    values[f.name] = min(most, max(least, int(raw.strip())))
                except ValueError:
                    values[f.name] = default
            elif isinstance(f.default, bool):
                values[f.name] = raw.strip().lower() in TRUE_WORDS
        return cls(**values)
