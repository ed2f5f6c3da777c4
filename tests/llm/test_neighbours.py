import numpy as np
import pytest

from knotwork.llm import neighbours as N

SCHEMA = "pid bigint, vec array<float>, sim double, rank int, node bigint"


def clusters(n=900, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 30, dims))
    v = centres[rng.integers(len(centres), size=n)] + 0.35 * rng.standard_normal((n, dims))
    return (v * rng.uniform(0.2, 5, size=(n, 1))).astype(np.float32)


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0.0, 0, 0) for i, v in enumerate(vectors)], SCHEMA)


def exact(vectors, k):
    ids = [i for i, v in enumerate(vectors) if v is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    m = np.array([vectors[i] for i in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 10)
    np.fill_diagonal(s, -2)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {ids[i]: [ids[j] for j in order[i]] for i in range(len(ids))}


def listed(near):
    out = {}
    for r in sorted(near.collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_recall_on_clusters(spark):
    vectors = clusters()
    df = frame(spark, vectors)
    near = N.nearest(N.build(df, "pid", "vec", block=64, trees=4), 10)
    got, want = listed(near), exact(vectors, 10)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.97 * 10 * len(want)
    r = N.recall(near, N.brute_force(df, "pid", "vec", 10, every=7)).first()
    assert r.n_true == 10 * len(range(0, 900, 7)) and r.recall >= 0.95


def test_small_sets_are_exact_with_copies_and_unusable_rows(spark):
    base = list(clusters(40, 8, 2))
    vectors = base + [base[3]] * 15 + [base[5] * np.float32(2)] + [None, [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [1.0, 2.0]]
    df = frame(spark, vectors)
    got, want = listed(N.nearest(N.build(df, "pid", "vec"), 5)), exact(vectors[:-1], 5)
    assert got == want


@pytest.mark.parametrize("vectors", [[], [[1.0, 0.0]], [[1.0, 0.0]] * 3])
def test_tiny(spark, vectors):
    got = listed(N.nearest(N.build(frame(spark, vectors), "pid", "vec"), 10))
    assert got == ({} if len(vectors) < 2 else {0: [1, 2], 1: [0, 2], 2: [0, 1]})


def test_pairs(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (1, 3, 0.5)], "id bigint, neighbour bigint, sim double")
    assert [tuple(r) for r in N.similar_pairs(near, 0.82).collect()] == [(1, 2, 0.9)]
