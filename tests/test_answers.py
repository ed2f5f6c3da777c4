import pytest
from pyspark.sql import functions as F

from knotwork.operators import answers, linking

NAMES = [("Q1", "Alpha", "A city."), ("Q2", "Beta Works", ""), ("Q3", "Gamma", "A poet."), ("Q4", None, None)]
RELS = [("P1", "author"), ("P2", "located in")]


@pytest.fixture
def parts(spark):
    names = spark.createDataFrame(NAMES, "id string, name string, descr string").fillna("")
    rels = spark.createDataFrame(RELS, "rel string, rel_name string")
    qs = spark.createDataFrame([(1, "Who wrote Beta Works?"), (2, "Where is Alpha?"), (3, "Nothing at all")], "qid bigint, question string")
    paths = spark.createDataFrame([(1, 1, "1:Q2;Q2|P1|Q3", 0.9), (1, 2, "1:Q2;Q2|P2|Q1;Q1|P2|Q3", 0.5), (1, 3, "1:Q2;Q2|P1|Q3;Q3|P2|Q1", 0.4), (2, 1, "2:Q1;Q1|P1|Q2", 0.3)], "qid bigint, rank int, state string, score double")
    seeds = spark.createDataFrame([(1, "Q2"), (2, "Q1"), (2, "Q1")], "qid bigint, id string")
    return names, rels, qs, paths, seeds


def test_labels_keep_counting_and_edges_are_cited_once(spark, parts):
    names, rels, qs, paths, seeds = parts
    edges = answers.labelled_edges(paths, names, rels)
    assert {(r.qid, r.label, r.cited) for r in edges.collect()} == {(1, "P1.E1", "P1.E1"), (1, "P2.E1", "P2.E1"), (1, "P2.E2", "P2.E2"), (1, "P3.E1", "P1.E1"), (1, "P3.E2", "P3.E2"), (2, "P1.E1", "P1.E1")}
    got = {r.qid: r for r in answers.context(edges, answers.seed_lines(seeds, names)).collect()}
    assert got[1].n_citations == 5 and got[2].n_citations == 2
    lines = got[2].context.split("\n")
    assert lines == ["[S1] Alpha (Q1): A city.", "Path 1: [P1.E1] Alpha (Q1) --author (P1)--> Beta Works (Q2).", answers.POLICY]


def test_answers_cite_what_supports_them(spark, parts):
    names, rels, qs, paths, seeds = parts
    got = {r.qid: r for r in answers.answers(qs, paths, seeds, names, rels).collect()}
    assert got[1].answer == "The KG lists Gamma (Q3) as the author of Beta Works. [P1.E1]" and got[1].citations == ["P1.E1", "P3.E1"] and not got[1].was_skipped
    assert got[2].answer == "• [P1.E1] Alpha has relation 'author' with Beta Works." and got[2].citations == ["S1"]
    assert got[3].answer == answers.SKIPPED and got[3].was_skipped and got[3].citations == []


def test_a_model_may_answer(spark, parts):
    names, rels, qs, paths, seeds = parts
    echo = lambda df: df.selectExpr("qid", "concat('It is Gamma: ', substring(context, 1, 4)) AS answer")
    got = {r.qid: r for r in answers.answers(qs, paths, seeds, names, rels, generate=echo).collect()}
    assert got[1].answer == "It is Gamma: [S1]" and got[1].citations == ["P1.E1", "P3.E1"] and got[3].was_skipped


def test_no_paths(spark, parts):
    names, rels, qs, paths, seeds = parts
    assert all(r.was_skipped for r in answers.answers(qs, paths.where("false"), seeds, names, rels).collect())


def test_robust_mentions(spark):
    rows = [("Who is the founder of the Beta Works in Alpha?",), ("the of in",), (None,), ("India’s river",)]
    got = [r.m for r in spark.createDataFrame(rows, "q string").select(linking.robust_mentions(F.col("q")).alias("m")).collect()]
    assert "beta works" in got[0] and "alpha" in got[0] and "founder" not in got[0] and got[0][0].count(" ") >= 1
    assert got[1] == [] and not got[2] and "india's" in got[3]


def test_robust_scores_prefer_scope_and_degree(spark):
    q = spark.createDataFrame([(1, "What is Alpha?")], "qid bigint, question string")
    ents = spark.createDataFrame([("Q1", "Alpha", "", "a city"), ("Q2", "Alpha", "", "an album by X"), ("Q3", "Beta", "Alpha", "")], "id string, name string, aliases string, descr string")
    members = spark.createDataFrame([("Q1", 5), ("Q2", 6)], "id string, pid int")
    scope = spark.createDataFrame([(1, 5)], "qid bigint, pid int")
    degrees = spark.createDataFrame([("Q3", 100_000)], "id string, degree bigint")
    got = [(r.id, round(r.confidence, 3)) for r in linking.robust_selection(linking.robust_scores(q, ents, members, scope, degrees)).orderBy("rank").collect()]
    assert got == [("Q1", 1.704), ("Q3", 1.35), ("Q2", 0.858)]


def test_links_of_one_side_only(spark):
    lex = spark.createDataFrame([(1, "Q1", 2), (1, "Q2", 1)], "qid bigint, id string, n_words int")
    den = spark.createDataFrame([(1, "Q2", 0.9), (1, "Q3", 0.1), (2, "Q9", 0.4)], "qid bigint, id string, sim double")
    got = {(r.qid, r.id): round(r.score, 3) for r in linking.hybrid_links(lex, den).collect()}
    assert got == {(1, "Q1"): 0.7, (1, "Q2"): 0.65, (1, "Q3"): 0.0, (2, "Q9"): 0.12}
    gold = spark.createDataFrame([(1, "Q2"), (3, "Q1")], "qid bigint, id string")
    m = {r.qid: (r.recall, r.hit_1, r.mrr) for r in linking.link_metrics(linking.hybrid_links(lex, den), gold).collect()}
    assert m == {1: (1.0, 0, 0.5), 3: (0.0, 0, 0.0)}
