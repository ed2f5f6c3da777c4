"""Results per key where a few keys hold most rows: value-frequency compression.

Rows are first counted per (key, value), which Spark combines on the map side and shuffles by key
*and* value, so that one hot key spreads over all tasks. Exact distinct counts and modes are then
sums and maxima over the weighted values, again combined before the shuffle by key alone: what
reaches the task of a key is one partial row per map task, never the key's rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compress(df: DataFrame, key: Column, values: Mapping[str, Column]) -> DataFrame:
    """``key``, ``what`` (int, position in ``values``), ``value``, ``n``: rows per key and value of each column."""
    pairs = F.array(*[F.struct(F.lit(i).alias("what"), v.cast("string").alias("value")) for i, v in enumerate(values.values())])
    return (
        df.select(key.cast("string").alias("key"), F.explode(pairs).alias("p"))
        .groupBy("key", F.col("p.what").alias("what"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def key_profile(df: DataFrame, key: Column, values: Mapping[str, Column], modes: bool = True) -> DataFrame:
    """One row per non-null key: ``key``, ``n_rows``, and for each named value ``n_<name>`` (distinct non-null values),
    ``top_<name>`` and ``top_<name>_rows`` (mode; ties go to the smaller value).

    Null keys are left out; null values count as rows but not as values, and a key with null values only has a null
    mode. Repeated rows count each time. An empty table gives an empty result. Without ``values`` only rows are counted.
    """
    named = dict(values) or {"": F.lit(1)}
    weighted = compress(df, key, named).where("key is not null")
    aggs = [F.sum(F.when(F.col("what") == 0, F.col("n")).otherwise(0)).alias("n_rows")]
    for i, name in enumerate(named):
        if not name:
            continue
        mine = (F.col("what") == i) & F.col("value").isNotNull()
        aggs.append(F.count_if(mine).alias(f"n_{name}"))
        if modes:
            # The largest (n, value) with ties to the smaller value: the least (-n, value).
            best = F.min(F.when(mine, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))))
            aggs += [best["v"].alias(f"top_{name}"), (-best["n"]).alias(f"top_{name}_rows")]
    return weighted.groupBy("key").agg(*aggs)


def weighted_percentile(df: DataFrame, key: Column, value: Column, q: float) -> DataFrame:
    """Exact nearest-rank percentile of a numeric ``value`` per key from weighted values: ``key``, ``percentile``.

    The running weights of one key run over its distinct values only, not over its rows. Null keys and values are left out.
    """
    from pyspark.sql import Window

    weighted = df.select(key.cast("string").alias("key"), value.cast("double").alias("value")).where("key is not null and value is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    total = weighted.groupBy("key").agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("value"))
    reached = weighted.withColumn("upto", upto).join(total, "key").where(F.col("upto") >= F.greatest(F.ceil(F.col("total") * q), F.lit(1)))
    return reached.groupBy("key").agg(F.min("value").alias("percentile"))


def hot_keys(profile: DataFrame, n_all_rows: DataFrame, share: float) -> DataFrame:
    """Rows of a profile whose key holds at least ``share`` of the rows that ``n_all_rows`` (one row, one column) counts."""
    return profile.where(F.col("n_rows") >= F.lit(share) * n_all_rows.scalar())
