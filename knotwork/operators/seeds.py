"""Seed entities of questions: mentions matched to names and aliases, scored and selected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators.kg import alias_list

# Openings of definitional questions and the words of entertainment records.
DEFINITIONAL = ("what is a ", "what is an ", "what is ")
MEDIA_WORDS = ("album", "song", "film", "movie", "band")
MEDIA_RECORDS = ("studio album", "compilation album", "single by", "song by", "film directed")


def lexicon(ents: DataFrame) -> DataFrame:
    """``id, term, exact``: lower-case names and aliases of entities; every term names its entity exactly."""
    own = ents.where("name <> ''").select("id", F.lower("name").alias("term"))
    other = ents.select("id", F.explode(F.transform(alias_list("aliases"), lambda a: F.lower(a))).alias("term"))
    return own.unionByName(other).distinct()


def score(questions: DataFrame, ents: DataFrame, members: DataFrame, scope: DataFrame, least: float = 0.35) -> DataFrame:
    """``qid, id, term, pid, confidence`` of every entity a question mentions, the best mention of each.

    1 for the match, 0.1 per word of the mention up to 0.3, 0.5 if the entity's partition is in the question's scope
    (``scope``: qid, pid, or pid alone for all questions), the words of the description / 500 up to 0.15, and 0.25 off for entertainment records in
    definitional questions that do not ask for them. Ties go to the longer, then the smaller mention.
    """
    asked = questions.select("qid", F.lower("question").alias("q"), F.explode(T.mentions(F.col("question"))).alias("term"))
    met = asked.join(lexicon(ents), "term").join(ents.select("id", "descr"), "id").join(members, "id", "left").join(scope.distinct().withColumn("inside", F.lit(True)), scope.columns, "left")
    n_words = F.size(F.filter(F.split("descr", r"\s+"), lambda w: w != ""))
    media = T.any_of(F.lower(F.substring("descr", 1, 140)), MEDIA_RECORDS)
    opens = F.col("q").startswith(DEFINITIONAL[0])
    for start in DEFINITIONAL[1:]:
        opens = opens | F.col("q").startswith(start)
    confidence = 1.0 + F.least(F.lit(0.3), 0.1 * F.size(F.split("term", " "))) + F.when(F.col("inside"), 0.5).otherwise(0.0) + F.least(F.lit(0.15), n_words / 500.0) - F.when(opens & ~T.any_of(F.col("q"), MEDIA_WORDS) & media, 0.25).otherwise(0.0)
    scored = met.select("qid", "id", "term", "pid", F.round(confidence, 9).alias("confidence")).where(F.col("confidence") >= least)
    best = Window.partitionBy("qid", "id").orderBy(F.desc("confidence"), F.desc(F.length("term")), "term")
    return scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def select(scored: DataFrame, per_mention: int = 1, most: int = 3) -> DataFrame:
    """The ``most`` seeds of each question with at most ``per_mention`` of the same mention; adds ``rank``."""
    own = Window.partitionBy("qid", "term").orderBy(F.desc("confidence"), "id")
    capped = scored.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= per_mention).drop("nth")
    order = Window.partitionBy("qid").orderBy(F.desc("confidence"), "id")
    return capped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def fallback(questions: DataFrame, selected: DataFrame, hits: DataFrame, members: DataFrame, n_hits: int = 2, n_members: int = 3) -> DataFrame:
    """``qid, id, pid``: for questions without a seed the first members of their best partitions (``hits``: qid, pid, rank)."""
    bare = questions.select("qid").join(selected.select("qid"), "qid", "left_anti")
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy("id"))).where(F.col("nth") <= n_members).drop("nth")
    return bare.join(hits.where(F.col("rank") <= n_hits), "qid").join(first, "pid").select("qid", "id", "pid")
