"""Lexical and dense routing of questions to partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import Workspace

K1, B = 1.5, 0.75
RRF_K = 60
EPSILON = 1e-10


class Postings:
    """A lexical index: ``tf`` (id, token, tf), ``lengths`` (id, dl), ``df`` (token, df) and one-row ``stats`` (n_docs, avg_dl)."""

    def __init__(self, tokens: DataFrame, keep: bool = False):
        """``tokens``: one row per occurrence, ``id, token``. ``keep`` writes ``tf`` to the shared folder, for more than one use."""
        self.tf = tokens.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
        if keep:
            self.tf = Workspace(tokens.sparkSession, "postings").write(self.tf, "tf")
        self.lengths = self.tf.groupBy("id").agg(F.sum("tf").alias("dl"))
        self.df = self.tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        self.stats = self.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def bm25(index: Postings, terms: DataFrame, distinct_terms: bool = True) -> DataFrame:
    """``qid, id, score`` of the documents that share a term with a question; ``terms`` has ``qid, token``.

    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``. A term counts once per question, or as often as it stands there.
    Terms meet the postings by token, after document frequency and document length have been joined to them.
    """
    asked = terms.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qtf"))
    n_docs, avg_dl = index.stats.select("n_docs").scalar(), index.stats.select("avg_dl").scalar()
    wanted = asked.join(index.df, "token").withColumn("idf", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    met = wanted.join(index.tf, "token").join(index.lengths, "id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg_dl))
    if not distinct_terms:
        part = part * F.col("qtf")
    return met.groupBy("qid", "id").agg(F.round(F.sum(part), 9).alias("score"))


def minmax(scores: DataFrame, name: str, epsilon: float = EPSILON) -> Column:
    """``(x - min) / (max - min + epsilon)`` within a question."""
    w = Window.partitionBy("qid")
    return (F.col(name) - F.min(name).over(w)) / (F.max(name).over(w) - F.min(name).over(w) + epsilon)


def both_scores(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """``qid, id, d, b``: dense scores of all partitions with the lexical score, 0 where no term meets."""
    return dense.withColumnRenamed("score", "d").join(lexical.withColumnRenamed("score", "b"), ["qid", "id"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))


def fuse(scores: DataFrame, weight: float = 0.5, normalize_dense: bool = True) -> DataFrame:
    """``qid, id, score``: ``weight`` of the min-max dense (or, if so wished, the raw dense) plus the rest of the min-max lexical score."""
    mixed = scores.select("qid", "id", (minmax(scores, "d") if normalize_dense else F.col("d")).alias("dn"), minmax(scores, "b").alias("bn"))
    return mixed.select("qid", "id", F.round(weight * F.col("dn") + (1 - weight) * F.col("bn"), 9).alias("score"))


def reciprocal_rank_fusion(scores: DataFrame, k: int = RRF_K) -> DataFrame:
    d = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("d"), "id"))
    b = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("b"), "id"))
    return scores.select("qid", "id", F.round(1 / (k + d) + 1 / (k + b), 9).alias("score"))


def sweep(scores: DataFrame, gold: DataFrame, weights: list[float], k: int = 5) -> DataFrame:
    """``weight, hits, n``: questions with a gold partition among the ``k`` best, for every weight in one pass."""
    mixed = scores.select("qid", "id", minmax(scores, "d").alias("dn"), minmax(scores, "b").alias("bn"))
    each = mixed.withColumn("weight", F.explode(F.array(*map(F.lit, weights)))).withColumn("score", F.round(F.col("weight") * F.col("dn") + (1 - F.col("weight")) * F.col("bn"), 9))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("weight", "qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    hit = top.join(gold.select("qid", "id").distinct().withColumn("gold", F.lit(True)), ["qid", "id"], "left").groupBy("weight", "qid").agg(F.max(F.coalesce("gold", F.lit(False))).alias("hit"))
    return hit.groupBy("weight").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per question of ``gold`` (qid, id): first hit rank (0 without), reciprocal rank, hits and recall at each cut."""
    wanted = gold.select("qid", "id").distinct()
    joined = wanted.join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    per = joined.groupBy("qid").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n_gold"), *[F.count_if(F.col("rank") <= c).alias(f"found_{c}") for c in cuts])
    out = [F.coalesce("first", F.lit(0)).cast("bigint").alias("first_hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), "n_gold"]
    out += [(F.col(f"found_{c}") > 0).cast("int").alias(f"hit_{c}") for c in cuts] + [F.round(F.col(f"found_{c}") / F.col("n_gold"), 6).alias(f"recall_{c}") for c in cuts]
    return per.select("qid", *out)
