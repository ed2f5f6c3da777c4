import random

from knotwork.operators import graph as G


def planted(spark):
    rng, edges = random.Random(1), []
    for c in range(4):
        nodes = [f"c{c}n{i}" for i in range(12)]
        edges += [(a, b, 1.0) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if rng.random() < 0.7]
    edges += [("c0n0", "c1n0", 1.0), ("c1n1", "c2n1", 1.0)]
    return spark.createDataFrame(edges, "u string, v string, w double")


def test_communities_find_planted_groups_and_are_repeatable(spark):
    g = planted(spark)
    found = {r.id: r.label for r in G.communities(g, gamma=1.0).collect()}
    again = {r.id: r.label for r in G.communities(g.repartition(7), gamma=1.0).collect()}
    assert found == again and len(found) == 48
    same = sum((found[a] == found[b]) == (a[:2] == b[:2]) for a in found for b in found)
    assert same >= 0.9 * 48 * 48
    labels = spark.createDataFrame([(n, hash(v) % 1000) for n, v in found.items()], "id string, pid int")
    assert G.modularity(g, labels).first().modularity > 0.6


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30) if i != 14], "u string, v string")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(31)] + [("z",)], "id string")
    got = {r.id: r.component for r in G.components(e, nodes).collect()}
    assert got == {f"n{i:02d}": "n00" if i < 15 else "n15" for i in range(31)} | {"z": "z"}


def test_capped_assignment_respects_room_and_overflows_to_the_nearest(spark):
    cands = spark.createDataFrame([(f"e{i}", p, 0.9 - 0.1 * p - 0.001 * i) for i in range(10) for p in (1, 2)], "id string, pid int, sim double")
    room = spark.createDataFrame([(1, 3), (2, 4)], "pid int, room bigint")
    rows = {r.id: (r.pid, r.overflow) for r in G.capped_assignment(cands, room).collect()}
    assert len(rows) == 10
    assert sorted(i for i, (p, o) in rows.items() if p == 1 and not o) == ["e0", "e1", "e2"]
    assert sorted(i for i, (p, o) in rows.items() if p == 2 and not o) == ["e3", "e4", "e5", "e6"]
    assert all(rows[f"e{i}"] == (1, True) for i in (7, 8, 9))


def test_split_and_gini(spark):
    labels = spark.createDataFrame([(f"e{i}", 1 if i < 90 else 2) for i in range(100)], "id string, pid int")
    parts = {}
    for r in G.split_oversized(labels, 40).collect():
        parts.setdefault((r.pid, r.part), []).append(r.id)
    assert set(parts) == {(1, 0), (1, 1), (1, 2), (2, 0)} and sum(map(len, parts.values())) == 100
    sizes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 4)], "pid int, size bigint")
    assert abs(G.gini(sizes).first().gini - 0.3125) < 1e-12


def test_small_partitions_merge_until_none_can(spark):
    from knotwork.operators.graph import merge_rounds

    sizes = [(1, 1), (2, 1), (3, 1), (4, 9), (5, 1), (6, 10), (7, 1)]
    links = [(1, 2, 5), (2, 3, 4), (3, 4, 1), (5, 6, 2)]
    df, ln = spark.createDataFrame(sizes, "pid int, size bigint"), spark.createDataFrame(links, "a int, b int, weight bigint")
    into = {r.pid: r.into for r in merge_rounds(df, ln, 4, (10, None)).collect()}
    assert set(into) == {1, 2, 3, 4, 5, 6, 7} and into[7] == 7
    total = {}
    for pid, n in sizes:
        total[into[pid]] = total.get(into[pid], 0) + n
    assert all(n >= 4 for label, n in total.items() if label != 7)
    kept = {r.pid: r.into for r in merge_rounds(df, ln, 4, (10,), strict=True).collect()}
    total = {}
    for pid, n in sizes:
        total[kept[pid]] = total.get(kept[pid], 0) + n
    assert max(total.values()) <= 10 and kept[5] == 5
    assert merge_rounds(df.where("false"), ln, 4, (10, None)).count() == 0


def test_long_chains_are_one_component(spark):
    from knotwork.operators.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "u int, v int")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), 900, 901, 950]], "id int")
    got = {r.id: r.component for r in components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900, 950: 950}
