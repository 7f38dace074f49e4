"""Names within names against a nested loop."""

import random

import pytest

from garimpo.operators import containment


def names(rng, n):
    out = ["".join(rng.choice("abAB./é") for _ in range(rng.choice((0, 1, 2, 3, 4, 8, 60)))) for _ in range(n)]
    return out + [None, "", "a", "AB", "x" * 500, "xx", out[3] + out[4]]


@pytest.mark.parametrize("gram", [1, 3, 5])
def test_equals_a_nested_loop(spark, gram):
    rng = random.Random(gram)
    a, b = names(rng, 120), names(rng, 150)
    got = containment.either_contains(spark.createDataFrame([(x,) for x in a], "left string"), spark.createDataFrame([(x,) for x in b], "right string"), gram=gram)
    want = {(x, y) for x in a for y in b if x and y and (x.lower() in y.lower() or y.lower() in x.lower())}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_groups_documents_and_solutions(spark):
    expected = [(1, "Guia.pdf"), (1, "outro"), (2, "docs/manual.PDF"), (3, "nada"), (4, "a"), (None, "guia.pdf")]
    returned = [(1, "docs/GUIA.pdf"), (2, "manual.pdf"), (3, "guia.pdf"), (5, "nada")]
    e, r = spark.createDataFrame(expected, "query_id long, documento string"), spark.createDataFrame(returned, "query_id long, documento string")
    assert {x.query_id: x.doc_ok for x in containment.documents_ok(e, r).collect()} == {1: True, 2: True, 3: False, 4: False, None: False}
    ids = spark.createDataFrame([(1, "sol-1"), (2, "sol-2"), (3, "sol-3"), (4, "SOL-4")], "query_id long, id string")
    hits = spark.createDataFrame([(1, "sol-1", "x"), (2, "other", "fichas/sol-2.md"), (3, "sol-1", "sol-33"), (3, "sol-4", None), (4, "sol-4", "sol-4")], "query_id long, id string, documento string")
    assert {x.query_id: x.solution_ok for x in containment.solutions_ok(ids, hits).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_empty_sides(spark):
    some, none = spark.createDataFrame([("abc",)], "left string"), spark.createDataFrame([], "right string")
    assert containment.either_contains(some, none).collect() == []
    assert containment.either_contains(some.limit(0), spark.createDataFrame([("a",)], "right string")).collect() == []
