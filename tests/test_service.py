"""Model callables, the store and the rebuild queue."""

import threading

import pytest

from garimpo import options
from garimpo.operators import validation
from garimpo.plans.store import Rebuilds, Store, collection_of
from garimpo.sources import models, writers
from garimpo.streaming import conversations, limits


def test_endpoint_checks():
    assert models.checked_endpoint("http://127.0.0.1:11434/") == "http://127.0.0.1:11434"
    for bad in ("http://example.org", "ftp://localhost", "localhost", ""):
        with pytest.raises(ValueError):
            models.checked_endpoint(bad)
    assert models.checked_endpoint("http://example.org", True)
    with pytest.raises(ValueError):
        models.checked_model("x", ("y",))


def test_available_models():
    assert models.available_models(["b", "a"], lambda: ["a", "z"]) == ["a"]
    assert models.available_models(["b", "a"], lambda: []) == ["a", "b"]

    def down():
        raise OSError

    assert models.available_models(["b"], down) == ["b"]


def test_generated_and_embedded(spark):
    p = spark.createDataFrame([(0, "good"), (1, "bad")], "query_id long, prompt string").coalesce(1)

    def model(prompts):
        if "bad" in prompts:
            raise RuntimeError
        return [x.upper() for x in prompts]

    assert {r.query_id: r.answer for r in models.generated(p, model, batch=1).collect()} == {0: "GOOD", 1: None}
    t = spark.createDataFrame([(0, " ab "), (1, None)], "id long, texto string")
    got = {r.id: r.vector for r in models.embedded(t, lambda texts: [[float(len(x)), 0.0] for x in texts], 2).collect()}
    assert got == {0: [1.0, 0.0], 1: [1.0, 0.0]}
    with pytest.raises(Exception, match="has not 3 dimensions"):
        models.embedded(t, lambda texts: [[1.0, 0.0] for _ in texts], 3).collect()


def test_store():
    calls = []
    s = Store(lambda c: calls.append(c) or {"n": len(calls)})
    assert s.health("chunks") == {"status": "ok", "loaded": False}
    assert s.get("chunks") is s.get("chunks") and calls == ["chunks"]
    assert s.reload("chunks") == {"n": 2} and s.get("chunks") == {"n": 2}
    assert Store(lambda c: 1 / 0).health("x", load=True)["status"] == "degraded"
    assert collection_of("solucoes") == "solution_chunks"
    with pytest.raises(ValueError):
        collection_of("outros")


def test_rebuilds_run_in_turn_and_survive_failures():
    gate, log = threading.Event(), []
    fail = iter([False, True, False])

    def second():
        if next(fail):
            raise RuntimeError("no")

    r = Rebuilds([("a", lambda: gate.wait(10)), ("b", second)], log.append)
    assert [r.enqueue()["status"] for _ in range(3)] == ["started", "queued", "queued"]
    gate.set()
    assert r.wait() and (r.completed, r.failed) == (2, 1)
    assert [e["run"] for e in log if e["event"] == "start" and e["stage"] == "a"] == [1, 2, 3]


def test_access_without_some_keys(spark):
    from datetime import datetime

    rows = [(i, path, key) for i, (path, key) in enumerate([("/", None), ("/search", None), ("/search", "r"), ("/upload", "r"), ("/upload", "a"), ("/admin/x", "")])]
    df = spark.createDataFrame([(f"c{i}", datetime(2024, 1, 1), i, "GET", p, k) for i, p, k in rows], "client string, ts timestamp, request_id long, method string, path string, key string")
    codes = lambda *keys: [r.code for r in limits.access(df, *keys).orderBy("request_id").collect()]
    assert codes() == [200] * 6
    assert codes("r") == [200, 401, 200, 403, 403, 403]
    assert codes("", "a") == [200, 401, 401, 403, 200, 401]
    assert codes("r", "a") == [200, 401, 200, 403, 200, 401]


def test_env_file(tmp_path):
    f = tmp_path / "env"
    f.write_text("# x\nA=1\nB = 'two words'\n\nnothing\n=3\nC=\"q\nTOP_K=9\n")
    env = {"A": "kept"}
    assert options.env_file(str(f), env) == {"B": "two words", "C": '"q', "TOP_K": "9"} and env["A"] == "kept"
    assert options.Options.from_env(env=env).top_k == 9 and options.env_file(str(tmp_path / "none"), env) == {}


def test_files_leave_quarantine(tmp_path):
    q, a = tmp_path / "quarantine", tmp_path / "approved"
    q.mkdir()
    name = writers.quarantined_name()
    assert len(name) == 36
    (q / name).write_bytes(b"%PDF-")
    assert writers.approve_file(f"  x/{name} ", str(q), str(a)) == str(a / name) and (a / name).exists() and not (q / name).exists()
    for bad, error in (("", ValueError), ("a.txt", ValueError), ("gone.pdf", FileNotFoundError)):
        with pytest.raises(error):
            writers.approve_file(bad, str(q), str(a))
    (q / "link.pdf").symlink_to(tmp_path / "elsewhere.pdf")
    with pytest.raises(ValueError):
        writers.approve_file("link.pdf", str(q), str(a))


def test_events_are_recorded(spark, tmp_path):
    path = str(tmp_path / "audit")
    writers.record_event(spark, path, "search", "1.2.3.4", total=3)
    writers.record_event(spark, path, "reload")
    got = {r.event: r for r in spark.read.schema(conversations.AUDIT).json(path).collect()}
    assert got["search"].details == {"total": "3"} and got["reload"].client_ip == "desconhecido" and got["search"].ts is not None


def test_evaluation_rows(spark):
    c = spark.createDataFrame([(i, "x" * (150 + i * 30), f"d{i}", i) for i in range(6)], "id long, texto string, documento string, pagina int")

    def model(prompts):
        return ['```json\n{"question": "q", "ground_truth": "g"}\n```' if len(p) % 60 == 4 else "nada" for p in prompts]

    got = models.evaluation_rows(c, model, "ask ", 10).collect()
    assert {r.chunk_id for r in got} == {i for i in range(6) if 150 + i * 30 > 200 and (154 + i * 30) % 60 == 4} and all(r.question == "q" and len(r.context) == 1 for r in got) and got


def test_index_diagnosis(spark):
    c, v = spark.range(3), spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "id long, vector array<double>")
    row = validation.index_diagnosis(c, v, 2, spark.createDataFrame([(3,)], "total_chunks long"), spark.createDataFrame([(0.4,)], "dense_score double")).first()
    assert row.consistent and row.dims_ok and row.manifest_agrees and row.dense_probe_ok
    row = validation.index_diagnosis(c, v, 3, spark.createDataFrame([(4,)], "total_chunks long"), spark.createDataFrame([], "dense_score double")).first()
    assert not row.dims_ok and not row.manifest_agrees and not row.dense_probe_ok
