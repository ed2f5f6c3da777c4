from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.operators.skew import hot_keys, key_profile, weighted_percentile

SCHEMA = "k string, v string, n bigint"
ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", "z", None]), st.integers(0, 5)), max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS)
def test_profile_against_counting(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.key: (r.n_rows, r.n_v, r.top_v, r.top_v_rows) for r in key_profile(df, F.col("k"), {"v": F.col("v")}).collect()}
    want = {}
    for k in {r[0] for r in rows} - {None}:
        values = Counter(r[1] for r in rows if r[0] == k and r[1] is not None)
        top = min(values, key=lambda x: (-values[x], x)) if values else None
        want[k] = (sum(r[0] == k for r in rows), len(values), top, values.get(top))
    assert got == want


def test_hot_keys_share_counts_all_rows(spark):
    df = spark.createDataFrame([("a", "x", 1)] * 3 + [(None, "x", 1)] * 96 + [("b", "x", 1)], SCHEMA)
    hot = hot_keys(key_profile(df, F.col("k"), {}), df.agg(F.count(F.lit(1))), 0.03)
    assert [r.key for r in hot.collect()] == ["a"]


def test_weighted_percentile_is_nearest_rank(spark):
    df = spark.createDataFrame([("a", "x", n) for n in (1, 1, 1, 2, 9)] + [("b", "x", 4), (None, "x", 1)], SCHEMA)
    got = dict(map(tuple, weighted_percentile(df, F.col("k"), F.col("n"), 0.8).collect()))
    assert got == {"a": 2.0, "b": 4.0}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert key_profile(df, F.col("k"), {"v": F.col("v")}).count() == 0
