import numpy as np
import pytest

from knotwork.operators.vectors import coarse_nearest, products

SCHEMA = "id string, vec array<double>, score double"


def table(spark, rng, n, prefix, width=8):
    v = rng.standard_normal((n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(f"{prefix}{i:04d}", x.tolist(), 0.0) for i, x in enumerate(v)], SCHEMA), v


@pytest.mark.parametrize("block,rows", [(2048, 8192), (7, 11), (50, 64)])
@pytest.mark.parametrize("of", ["query", "row"])
def test_blocks_give_what_brute_force_gives(spark, block, rows, of):
    rng = np.random.default_rng(3)
    q, qv = table(spark, rng, 23, "q")
    c, cv = table(spark, rng, 60, "c")
    got = products(q.withColumnRenamed("id", "qid"), c, block=block, rows=rows, keep=4, of=of).collect()
    sims = np.round(qv @ cv.T, 9)
    want = set()
    for i, line in enumerate(sims if of == "query" else sims.T):
        for rank, j in enumerate(sorted(range(len(line)), key=lambda j: (-line[j], j))[:4]):
            want.add((f"q{i:04d}", f"c{j:04d}", rank + 1) if of == "query" else (f"q{j:04d}", f"c{i:04d}", rank + 1))
    assert {(r.qid, r.id, r["rank"]) for r in got} == want


def test_all_pairs_nulls_and_empty(spark):
    rng = np.random.default_rng(4)
    q, _ = table(spark, rng, 5, "q")
    c, _ = table(spark, rng, 9, "c")
    q = q.unionByName(spark.createDataFrame([("none", None, 0.0)], SCHEMA))
    for block in (2048, 2):
        assert products(q.withColumnRenamed("id", "qid"), c, block=block, rows=3).count() == 45
    assert products(q.withColumnRenamed("id", "qid").where("false"), c, keep=2).count() == 0
    assert products(q.withColumnRenamed("id", "qid"), c.where("false"), keep=2).count() == 0


def test_coarse_search_is_near_the_exact_one(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8)) * 4
    rows = [(f"c{i:03d}", (centres[i % 6] + rng.standard_normal(8) * 0.2).tolist(), 0.0) for i in range(120)]
    items = [(f"i{i:03d}", (centres[i % 6] + rng.standard_normal(8) * 0.2).tolist(), 0.0) for i in range(90)]
    scale = lambda v: (np.array(v) / np.linalg.norm(v)).tolist()
    r, it = ([(k, scale(v), s) for k, v, s in x] for x in (rows, items))
    got = {x.id: x.score for x in coarse_nearest(spark.createDataFrame(it, SCHEMA), spark.createDataFrame(r, SCHEMA), n_cells=6, probes=2).collect()}
    exact = np.array([v for _, v, _ in it]) @ np.array([v for _, v, _ in r]).T
    assert len(got) == 90
    assert sum(got[k] >= exact[i].max() - 1e-6 for i, (k, _, _) in enumerate(it)) >= 81
