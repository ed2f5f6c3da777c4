from datetime import datetime as T

from knotwork.operators.references import orphan_references, orphans_by_period

CHILD = "row bigint, a string, b string, at timestamp, reason string, salt int"
PARENT = "id string, loaded_at timestamp, deleted_at timestamp, range int"
D = {i: T(2024, 1, i) for i in range(1, 29)}


def run(spark, child, parents, **more):
    c = spark.createDataFrame(child, CHILD)
    p = spark.createDataFrame(parents, PARENT)
    return orphan_references(c, "row", "at", {"a": "things", "b": "things"}, {"things": (p, "id")}, **more)


PARENTS = [("Q1", D[5], None, 1), (" q1", D[3], None, 1), ("Q2", D[1], D[10], 1), (None, D[1], None, 1), ("  ", D[1], None, 1), ("Q3", None, None, 1)]


def test_missing_late_deleted(spark):
    child = [(1, "Q1", "Q2", D[4], "x", 0), (2, "Q1", "Q2\t", D[2], "x", 0), (3, "q2", None, D[10], "x", 0), (4, "", " ", D[9], "x", 0), (5, "Q9", "Q3", D[9], "x", 0)]
    got = sorted((r.row_id, r.field_name, r.reason) for r in run(spark, child, PARENTS).collect())
    assert got == [(2, "a", "late"), (3, "a", "deleted"), (5, "a", "missing"), (5, "b", "missing")]


def test_null_time_is_the_end_of_time(spark):
    got = sorted((r.field_name, r.reason, r.ref_at) for r in run(spark, [(1, "Q1", "Q2", None, "x", 0)], PARENTS).collect())
    assert got == [("b", "deleted", None)]


def test_empty_tables(spark):
    assert run(spark, [], PARENTS).count() == 0
    got = run(spark, [(1, "Q1", None, D[4], "x", 0)], [])
    assert [(r.row_id, r.reason) for r in got.collect()] == [(1, "missing")]


def test_hot_keys_are_salted_and_nothing_is_lost(spark):
    child = [(i, "Q1" if i % 3 else f"Q{i}", "Q2", D[4 + i % 10], "x", 0) for i in range(3000)]
    whole = sorted(map(tuple, run(spark, child, PARENTS).collect()))
    salted = sorted(map(tuple, run(spark, child, PARENTS, batch_rows=100, parents_per_range=1).collect()))
    assert salted == whole
    known, gone = {"Q1": 3, "Q2": 1}, {"Q2": 10}
    want = 0
    for i, a, b, at, *_ in child:
        for key in (a, b):
            want += known.get(key, 99) > at.day or gone.get(key, 99) <= at.day
    assert len(whole) == want


def test_repeated_rows_and_periods(spark):
    rows = run(spark, [(1, "Q9", None, D[4], "x", 0)] * 2 + [(2, "Q9", "Q1", D[2], "x", 0)], PARENTS)
    counts = sorted(map(tuple, orphans_by_period(rows).collect()))
    assert counts == [("things", "2024-01", "late", 1), ("things", "2024-01", "missing", 3)]


def test_keys_of_one_hash_are_told_apart():
    import numpy as np

    from knotwork.operators.references import _locate

    hashes, keys = np.array([1, 1, 1, 4]), np.array(["a", "b", "c", "d"])
    wanted, words = np.array([1, 1, 4, 4, 9, 1]), np.array(["c", "a", "d", "x", "d", "y"])
    assert _locate(hashes, wanted, lambda which, at: words[which] == keys[at]).tolist() == [2, 0, 3, -1, -1, -1]
    assert _locate(np.array([], np.int64), wanted, None).tolist() == [-1] * 6


def test_very_long_ids(spark):
    long = "Q" * 100_000
    got = run(spark, [(1, long, "Q1", D[9], "x", 0), (2, long + "X", None, D[9], "x", 0)], [*PARENTS, (long, D[1], None, 1)])
    assert [(r.row_id, r.reason) for r in got.collect()] == [(2, "missing")]
