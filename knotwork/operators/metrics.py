"""Evaluation metrics, summaries and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_f1(pairs: DataFrame) -> DataFrame:
    """``key, em, f1`` of ``key, pred, gold`` (arrays of tokens): multiset overlap; both empty count as equal."""
    p = pairs.select("key", F.explode("pred").alias("t")).groupBy("key", "t").agg(F.count(F.lit(1)).alias("np"))
    g = pairs.select("key", F.explode("gold").alias("t")).groupBy("key", "t").agg(F.count(F.lit(1)).alias("ng"))
    common = p.join(g, ["key", "t"]).groupBy("key").agg(F.sum(F.least("np", "ng")).alias("c"))
    total = F.size("pred") + F.size("gold")
    f1 = F.when(total == 0, 1.0).otherwise(2 * F.coalesce("c", F.lit(0)) / total)
    return pairs.join(common, "key", "left").select("key", (F.col("pred") == F.col("gold")).cast("int").alias("em"), f1.alias("f1"))


def set_scores(pred: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays as sets; null where the side that divides is empty."""
    both = F.size(F.array_intersect(pred, gold))
    n_pred, n_gold = F.size(F.array_distinct(pred)), F.size(F.array_distinct(gold))
    return {"precision": F.try_divide(both, n_pred), "recall": F.try_divide(both, n_gold), "f1": F.try_divide(2 * both, n_pred + n_gold)}


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, n, mean, median, p95, p99`` with linear interpolation; nulls are left out."""
    q = lambda p: F.round(F.expr(f"percentile({value}, {p})"), 6)
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def index_quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, median, p95`` by position: the values at ``n // 2`` and ``int(.95 n)`` of the sorted non-null values.

    Positions are found over distinct values with their counts, so equal values never meet in one sort.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    total = per.groupBy(by).agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    ranked = per.withColumn("upto", upto).join(total, by)
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col(value)))
    return ranked.groupBy(by).agg(at(F.lit(0.5)).alias("median"), at(F.lit(0.95)).alias("p95"))


#: Upper ends of the Poisson(1) distribution function: a uniform number below the i-th end, and no earlier one, draws i.
_POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998980223, 0.99999887480, 0.99999988857)


def poisson_weight(key: Column, resample: Column) -> Column:
    """How often an item is drawn into a resample: Poisson(1), from the first 48 bits of the MD5 of ``resample:key``.

    Any engine can recompute it, and whether an item is drawn depends on no other item.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", resample.cast("string"), key.cast("string"))), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    out = None
    for n, end in enumerate(_POISSON):
        out = F.when(u < end, n) if out is None else out.when(u < end, n)
    return out.otherwise(len(_POISSON))


def _resampled(items: DataFrame, resamples: int) -> DataFrame:
    """``m``: the pooled mean ``sum(s) / sum(c)`` of every resample of ``items`` (key, s, c).

    Weights are summed on the map side, so ``resamples`` rows a task are shuffled and nothing is joined.
    """
    draws = items.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", poisson_weight(F.col("key"), F.col("r")))
    return draws.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("c"))).alias("m"))


def _interval(items: DataFrame, resamples: int, name: str) -> DataFrame:
    """One row: the pooled mean of the items and the 2.5 and 97.5 percentiles over the resamples (at most ``resamples`` values)."""
    point = items.agg(F.try_divide(F.sum("s"), F.sum("c"))).scalar()
    return _resampled(items, resamples).agg(F.round(point, 6).alias(name), F.round(F.expr("percentile(m, 0.025)"), 6).alias("low"), F.round(F.expr("percentile(m, 0.975)"), 6).alias("high"))


def paired_bootstrap(pairs: DataFrame, resamples: int = 1000) -> DataFrame:
    """One row: mean ``difference`` of ``a - b`` with the ``low`` and ``high`` ends of its 95 % bootstrap interval.

    ``pairs``: key (unique), a, b. Each resample draws every item a Poisson(1) number of times, which for many items is the
    bootstrap with replacement. Pairs with a null side are left out; an empty table gives one row of nulls.
    """
    return _interval(pairs.where("a is not null and b is not null").select("key", (F.col("a") - F.col("b")).alias("s"), F.lit(1).alias("c")), resamples, "difference")


def cluster_bootstrap(rows: DataFrame, resamples: int = 1000) -> DataFrame:
    """As ``paired_bootstrap``, drawing whole clusters: ``rows`` has cluster, value; the statistic is the pooled ``mean``.

    Rows with a null cluster form one cluster.
    """
    per = rows.groupBy("cluster").agg(F.sum("value").alias("s"), F.count("value").alias("c")).where("c > 0")
    return _interval(per.select(F.coalesce(F.col("cluster").cast("string"), F.lit("")).alias("key"), "s", "c"), resamples, "mean")
