"""Beam width, path count and hops are each question's own."""

from knotwork.operators import traverse


def test_limits_follow_question_and_seeds(spark):
    qs = spark.createDataFrame([(1, "who wrote it"), (2, "list all children of x"), (3, "what is the birthplace of y"), (4, "many seeds")], "qid bigint, question string")
    seeds = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")] + [(4, f"S{i}") for i in range(4)], "qid bigint, id string")
    got = {r.qid: (r.hops, r.width, r.n_paths) for r in traverse.limits(qs, seeds).collect()}
    assert got == {1: (2, 5, 3), 2: (2, 15, 12), 3: (3, 12, 3), 4: (2, 12, 3)}


def test_search_cuts_by_each_questions_limits(spark):
    edges = spark.createDataFrame([("A", "P1", f"B{i:02d}") for i in range(20)] + [("C0", "P1", "C1"), ("C1", "P1", "C2"), ("C2", "P1", "C3"), ("C3", "P1", "C4")], "src string, rel string, dst string")
    ids = ["A"] + [f"B{i:02d}" for i in range(20)] + [f"C{i}" for i in range(5)]
    names = spark.createDataFrame([(i, i, "") for i in ids], "id string, name string, descr string")
    rels = spark.createDataFrame([("P1", "child")], "rel string, rel_name string")
    qs = spark.createDataFrame([(1, "who wrote it"), (2, "list all children of x"), (3, "what is the birthplace of y")], "qid bigint, question string")
    seeds = spark.createDataFrame([(1, "A"), (2, "A"), (3, "C0")], "qid bigint, id string")
    rows = traverse.search(seeds, edges, names, rels, qs, own=traverse.limits(qs, seeds)).collect()
    assert sum(r.qid == 1 for r in rows) == 3 and sum(r.qid == 2 for r in rows) == 12
    assert {r.node for r in rows if r.qid == 3} == {"C1", "C2", "C3"}
