import math
import random

import pytest

from knotwork.operators.metrics import cluster_bootstrap, paired_bootstrap


@pytest.mark.parametrize("n", [300, 997])
def test_interval_is_near_the_normal_one(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.gauss(1, 2), rng.gauss(0, 1)) for i in range(n)]
    d = [a - b for _, a, b in rows]
    mean = sum(d) / n
    width = 2 * 1.96 * math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1) / n)
    got = paired_bootstrap(spark.createDataFrame(rows, "key bigint, a double, b double"), 1000).first()
    assert abs(got.difference - mean) < 1e-6
    assert abs((got.high - got.low) / width - 1) < 0.2
    assert got.low < mean < got.high


def test_clusters_are_drawn_whole(spark):
    rng = random.Random(5)
    rows = [(f"c{c}", m + rng.gauss(0, 0.1)) for c, m in ((c, rng.gauss(0, 1)) for c in range(300)) for _ in range(4)]
    means = [sum(v for k, v in rows if k == f"c{c}") / 4 for c in range(300)]
    centre = sum(means) / 300
    width = 2 * 1.96 * math.sqrt(sum((m - centre) ** 2 for m in means) / 299 / 300)
    got = cluster_bootstrap(spark.createDataFrame(rows, "cluster string, value double"), 1000).first()
    assert abs(got.mean - centre) < 1e-6 and abs((got.high - got.low) / width - 1) < 0.2


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 2.0, 1.0), (3, 2.0, None)], "key bigint, a double, b double")
    assert paired_bootstrap(df, 100).first().difference == 1.0
    assert paired_bootstrap(df.where("false"), 100).first().difference is None
    assert cluster_bootstrap(df.select(df.a.alias("cluster"), df.b.alias("value")).where("false"), 100).first().mean is None
