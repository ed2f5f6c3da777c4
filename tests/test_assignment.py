"""Capped assignment against one item at a time, with more full candidates than ten and more rounds than 64."""

import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from knotwork.operators import graph as G
from knotwork.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_rounds_go_on_until_all_who_can_be_placed_are(spark):
    n = 66
    cands = spark.createDataFrame([(f"e{i:02d}", p, 1.0 - 0.01 * p - 0.0001 * i) for i in range(n) for p in range(n)], "id string, pid int, sim double")
    room = spark.createDataFrame([(p, 1) for p in range(n)], "pid int, room bigint")
    rows = {r.id: (r.pid, r.overflow) for r in G.capped_assignment(cands, room).collect()}
    assert rows == {f"e{i:02d}": (i, False) for i in range(n)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_the_eleventh_nearest_centroid_is_tried(spark, tmp_path):
    for name in ("entities", "relations", "triples"):
        os.symlink(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    cen, members = pq.read_table(f"{FOLDER}/centroids.parquet"), pd.read_parquet(f"{FOLDER}/entity_map.parquet")
    pids = sorted(set(cen["partition_id"].to_pylist()))
    ids = sorted(set(members.entity_id.dropna().str.strip().str.upper()))
    free = pids[-1]
    # Every partition but the last is full, by members that no table names; the last has room for all.
    full = [(f"Q9{p:04d}{i:02d}", p) for p in pids if p != free for i in range(60)]
    schema = pq.read_schema(f"{FOLDER}/entity_map.parquet")
    table = pd.DataFrame(full, columns=["entity_id", "partition_id"])
    for field in schema:
        if field.name not in table:
            table[field.name] = None
    pq.write_table(pa.Table.from_pandas(table[schema.names], schema=schema, preserve_index=False), tmp_path / "entity_map.parquet")
    pq.write_table(cen, tmp_path / "centroids.parquet")
    rows = catalogue.QUERIES["capped_assign"](spark, str(tmp_path)).collect()
    placed = [r for r in rows if not r.overflow]
    assert len(ids) > 60 and len(rows) > 60
    assert len(placed) == 60 and {r.pid for r in placed} == {free}
