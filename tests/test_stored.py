"""Stored upserts and rebuilds: crashes, order, conflicts, restarts."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from garimpo.files import Exists, Files
from garimpo.plans.versioned import Conflict, VersionedTable
from garimpo.streaming.rebuilds import Rebuilds


def rows(spark, *some):
    return spark.createDataFrame(list(some), "id string, documento string, area string")


def ids(df):
    return sorted(((r.id, r.documento, r.area) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "library"), ["id", "documento"])
    t.replace(rows(spark, ("1", "a.pdf", "x"), ("2", "b.pdf", "x"), ("3", "c.pdf", "x"), (None, "d.pdf", "x"), (None, None, "x")))
    return t


def test_upserts_replace_by_any_key_and_stay_after_compaction(spark, table):
    table.upsert(rows(spark, ("2", "new.pdf", "y"), ("9", "a.pdf", "y")))
    table.upsert(rows(spark, ("9", "z.pdf", "z"), (None, None, "w")))
    want = ids(rows(spark, ("3", "c.pdf", "x"), (None, "d.pdf", "x"), (None, None, "x"), ("2", "new.pdf", "y"), ("9", "z.pdf", "z"), (None, None, "w")))
    assert ids(table.read()) == want  # a.pdf was replaced by 9, which was replaced: it doesn't come back
    assert [len(ids(table.read(v))) for v in (1, 2, 3)] == [5, 5, 6]
    version = table.compact()
    assert version == 4 and table.manifest()["deltas"] == [] and ids(table.read()) == want
    assert len(table.vacuum()) == 3 and ids(table.read()) == want and table.versions() == [4]
    table.upsert(spark.createDataFrame([("3",)], "id string"), gone=True)
    assert ids(table.read()) == [w for w in want if w[0] != "3"]


def test_a_table_can_be_made_from_itself(spark, table):
    table.replace(table.read().where("id = '1'").withColumn("area", F.lit("self")))
    assert ids(table.read()) == [("1", "a.pdf", "self")]


def test_a_crash_between_data_and_manifest_changes_nothing(spark, table, monkeypatch):
    before = ids(table.read())
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        for step in (lambda: table.upsert(rows(spark, ("1", "q.pdf", "lost"))), lambda: table.replace(rows(spark))):
            with pytest.raises(KeyboardInterrupt):
                step()
    assert ids(table.read()) == before and table.versions() == [1]
    assert len(table.vacuum()) == 2 and ids(table.read()) == before
    table.upsert(rows(spark, ("1", "q.pdf", "kept")))
    assert ("1", "q.pdf", "kept") in ids(table.read())


def test_two_writers(spark, table):
    other = VersionedTable(spark, table.root, table.keys)
    stale = table.manifest()
    other.upsert(rows(spark, ("1", "a.pdf", "other")))
    with pytest.raises(Conflict):
        table._commit({**stale, "version": stale["version"] + 1})
    real = table.manifest
    seen = iter([real(), stale])  # what this writer saw before the other one came
    table.manifest = lambda version=None: next(seen, None) or real(version) if version is None else real(version)
    table.upsert(rows(spark, ("2", "b.pdf", "mine")))
    assert [a for a in ids(other.read()) if a[0] in ("1", "2")] == [("1", "a.pdf", "other"), ("2", "b.pdf", "mine")]


def test_many_deltas_are_compacted(spark, table):
    for i in range(5):
        table.upsert(rows(spark, ("1", "a.pdf", f"v{i}")), most=3)
    assert len(table.manifest()["deltas"]) < 3 and ("1", "a.pdf", "v4") in ids(table.read())
    with pytest.raises(LookupError):
        VersionedTable(spark, table.root + "-none", ["id"]).read()


def test_files_are_made_once(spark, tmp_path):
    files = Files(spark, str(tmp_path / "f"))
    files.create("a/x.json", "één")
    with pytest.raises(Exists):
        files.create("a/x.json", "other")
    assert files.read("a/x.json") == "één" and files.names("a") == ["x.json"] and files.names("b") == []


class Stops(Files):
    """Files that end the job, as a lost process would, when it comes to a certain one."""

    at = None

    def exists(self, name):
        if self.at and name.endswith(self.at):
            raise OSError("the process has ended")
        return super().exists(name)


def test_rebuilds_in_order_and_none_twice(spark, tmp_path):
    done = []

    def stage(name):
        def run(id):
            done.append((id, name))
            if name == "index" and id == bad:
                raise ValueError("no vectors")

        return name, run

    bad = None
    queue = Rebuilds(spark, str(tmp_path / "queue"), [stage("extract"), stage("index"), stage("swap")])
    queue.work()
    assert queue.snapshot() == {"queued": 0, "completed": 0, "failed": 0}
    asked = [queue.enqueue() for _ in range(3)]
    assert [(a["status"], a["code"], a["position"]) for a in asked] == [("started", 200, 1), ("queued", 409, 2), ("queued", 409, 3)]
    runs = [a["run"] for a in asked]
    bad = runs[1]
    queue.files = Stops(spark, queue.root)
    queue.files.at = f"{runs[0]}/002-swap.json"  # in mid-run of the first
    with pytest.raises(StreamingQueryException):
        queue.work()
    assert done == [(runs[0], "extract"), (runs[0], "index")] and queue.pending() == runs
    queue = Rebuilds(spark, str(tmp_path / "queue"), queue.stages)  # another process
    queue.work()
    assert done == [(runs[0], "extract"), (runs[0], "index"), (runs[0], "swap"), (runs[1], "extract"), (runs[1], "index"), (runs[2], "extract"), (runs[2], "index"), (runs[2], "swap")]
    assert queue.snapshot() == {"queued": 0, "completed": 2, "failed": 1}
    assert [r.error for r in queue.events().where("event = 'fail'").collect()] == ["index: no vectors"]
    queue.work()
    assert len(done) == 8 and queue.enqueue()["code"] == 200
    queue.work()
    assert len(done) == 11
