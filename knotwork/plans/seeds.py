"""Queries of seed resolution: ``question_`` over every test question, ``seed_`` over the short first lines of documents, which name their entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import kg, retrieval, seeds, vectors
from knotwork.plans.retrieval import DEN, NRM, _top, dense_scores, fused_pairs
from knotwork.plans.sqlparts import ALIASES, ENT, MEM
from knotwork.plans.text import _in
from knotwork.sources import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def headings(spark, d):
    """``qid, question``: the first line of every document as the question that leads to its entity."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("qid"), F.get(F.split(F.trim("text"), "\n"), F.lit(0)).alias("question"))
    return t.where(F.size(T.tokens(F.col("question"))).between(1, 8))


def _grams(rel, longest):
    return " UNION ALL ".join(f"SELECT qid, array_to_string(list_slice(t, i, i + {n - 1}), ' ') AS m FROM (SELECT qid, t, unnest(range(1, len(t) - {n - 2})) AS i FROM {rel})" for n in range(1, longest + 1))


HEAD = rf"""hd AS (SELECT doc_id AS qid, string_split(trim(text), chr(10))[1] AS question FROM documents WHERE text IS NOT NULL), hq AS (SELECT * FROM hd WHERE len(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+')) BETWEEN 1 AND 8),
q AS (SELECT qid, regexp_extract_all(lower(replace(question, '’', '''')), '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)?') AS t FROM hq), s AS (SELECT qid, list_filter(t, lambda x: length(x) >= 2 AND x NOT IN {_in(T.STOP_WORDS)}) AS t FROM q),
men AS (SELECT DISTINCT qid, m FROM ({_grams('q', 5)} UNION ALL {_grams('s', 4)}) WHERE length(m) >= 2 AND m NOT IN {_in(T.MENTION_STOP)})"""
LEX = f"lex AS (SELECT id, lower(name) AS term FROM ent WHERE name <> '' UNION SELECT id, lower(unnest({ALIASES})) FROM ent)"
_OPEN = " OR ".join(f"starts_with(lower(h.question), '{p}')" for p in seeds.DEFINITIONAL)
_MEDIA_Q = " OR ".join(f"contains(lower(h.question), '{w}')" for w in seeds.MEDIA_WORDS)
_MEDIA_R = " OR ".join(f"contains(lower(substr(e.descr, 1, 140)), '{w}')" for w in seeds.MEDIA_RECORDS)
SCORE = rf"""{ENT}, {MEM}, {HEAD}, {LEX}, sco AS (SELECT men.qid, e.id, men.m AS term, mem.pid, round(1.0::DOUBLE + least(0.3::DOUBLE, 0.1::DOUBLE * len(string_split(men.m, ' '))) + CASE WHEN mem.pid IS NOT NULL AND mem.pid % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END
  + least(0.15::DOUBLE, len(list_filter(regexp_split_to_array(e.descr, '\s+'), lambda w: w <> '')) / 500.0::DOUBLE) - CASE WHEN ({_OPEN}) AND NOT ({_MEDIA_Q}) AND ({_MEDIA_R}) THEN 0.25::DOUBLE ELSE 0 END, 9) AS confidence
  FROM men JOIN hq h ON h.qid = men.qid JOIN lex ON lex.term = men.m JOIN ent e ON e.id = lex.id LEFT JOIN mem ON mem.id = e.id),
bst AS (SELECT qid, id, term, pid, confidence FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY confidence DESC, length(term) DESC, term) AS nth FROM sco WHERE confidence >= 0.35) WHERE nth = 1),
sel AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY confidence DESC, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, term ORDER BY confidence DESC, id) AS nth FROM bst) WHERE nth <= 1)"""


def _scored(spark, d):
    """The scope of all questions is the partitions with an even number, so that the boost is put to use."""
    q, members = headings(spark, d), kg.members(spark, d)
    scope = members.where("pid % 2 = 0").select("pid").distinct()
    return q, members, seeds.score(q, kg.entities(spark, d), members, scope)


@query(f"WITH {SCORE} SELECT qid, id, term, pid, round(confidence, 6) AS confidence FROM bst")
def seed_candidates(spark, d):
    return _scored(spark, d)[2].select("qid", "id", "term", "pid", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {SCORE} SELECT qid, id, term, round(confidence, 6) AS confidence, rank FROM sel WHERE rank <= 3")
def seed_selection(spark, d):
    return seeds.select(_scored(spark, d)[2]).select("qid", "id", "term", F.round("confidence", 6).alias("confidence"), "rank")


ROUTED = 5
_ASKED = f"hq AS (SELECT item_id AS qid, question FROM test_items WHERE question IS NOT NULL){HEAD[HEAD.index(f',{chr(10)}q AS'):]}"
_ROUTED = f"fu AS (SELECT qid, id, round(0.5::DOUBLE * dn + 0.5::DOUBLE * bn, 9) AS score FROM nr), scp AS ({_top('fu', ROUTED)})"
ASKED = f"{NRM}, {_ROUTED}, {_ASKED}, {LEX}, {SCORE[SCORE.index('sco AS'):].replace('mem.pid % 2 = 0', '(men.qid, mem.pid) IN (SELECT qid, id FROM scp)')}"


def _asked(spark, d):
    """Every test question, however long; its scope is its ``ROUTED`` best partitions by fused scores."""
    q = table(spark, d, "test_items").where("question is not null").select(F.col("item_id").alias("qid"), "question")
    scope = vectors.best(retrieval.fuse(fused_pairs(spark, d)), ROUTED).select("qid", F.col("id").cast("int").alias("pid"))
    return seeds.score(q, kg.entities(spark, d), kg.members(spark, d), scope)


@query(f"WITH {ASKED} SELECT qid, id, term, pid, round(confidence, 6) AS confidence FROM bst")
def question_seed_candidates(spark, d):
    return _asked(spark, d).select("qid", "id", "term", "pid", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {ASKED} SELECT qid, id, term, round(confidence, 6) AS confidence, rank FROM sel WHERE rank <= 3")
def question_seed_selection(spark, d):
    return seeds.select(_asked(spark, d)).select("qid", "id", "term", F.round("confidence", 6).alias("confidence"), "rank")


@query(f"WITH {DEN}, {MEM}, t AS ({_top('den', 2)}), f AS (SELECT pid, id, row_number() OVER (PARTITION BY pid ORDER BY id) AS nth FROM mem) SELECT t.qid, f.id, f.pid FROM t JOIN f ON f.pid = t.id WHERE f.nth <= 3")
def seed_fallback(spark, d):
    """First members of the two best partitions of every test question, as if none had a seed."""
    hits = dense_scores(spark, d, keep=2).select("qid", F.col("id").cast("int").alias("pid"), "rank")
    q = table(spark, d, "test_items").where("question is not null").select(F.col("item_id").alias("qid"))
    return seeds.fallback(q, q.where("false"), hits, kg.members(spark, d))
