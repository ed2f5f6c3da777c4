"""Context and answer hold every edge of a path; shares are each question's own."""

from pyspark.sql import functions as F

from knotwork.operators import traverse


def test_second_hop_stands_in_context_and_answer(spark):
    names = spark.createDataFrame([("A", "Ada", ""), ("B", "Bob", "x  y"), ("C", "Cy", "")], "id string, name string, descr string")
    rels = spark.createDataFrame([("P1", "child"), ("P2", "spouse")], "rel string, rel_name string")
    paths = spark.createDataFrame([(1, "1:A;A|P1|B;B|P2|C", 1), (1, "1:A;A|P1|B", 2)], "qid bigint, state string, rank int")
    assert traverse.context(paths, names, rels).first().context.split("\n") == [
        "Path 1: [P1.E1] Ada (A) --child (P1)--> Bob (B). Target description: x y",
        "Path 1: [P1.E2] Bob (B) --spouse (P2)--> Cy (C).",
        "Path 2: [P2.E1] Ada (A) --child (P1)--> Bob (B). Target description: x y",
    ]
    row = traverse.answer(paths, names, rels).first()
    assert (row.answer_id, row.answer) == ("C", "Ada child Bob. [P1.E1] Bob spouse Cy. [P1.E2]")


def test_fair_share_takes_each_questions_count(spark):
    rows = [(q, s, f"{s}{i}", 1.0 - 0.1 * i - (s == "B"), n) for q, n in ((1, 2), (2, 4)) for s in "AB" for i in range(5)]
    paths = spark.createDataFrame(rows, "qid bigint, seed string, state string, score double, n_paths int")
    got = {(r.qid, r.state) for r in traverse.fair_share(paths, F.col("n_paths")).collect()}
    assert got == {(1, "A0"), (1, "B0"), (2, "A0"), (2, "A1"), (2, "B0"), (2, "B1")}
