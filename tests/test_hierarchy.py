import random

from knotwork.operators.hierarchy import descendant_counts, descendants, unroll

SCHEMA = "grp string, child string, parent string, depth int, root string"


def edges(spark, pairs, group="g"):
    return spark.createDataFrame([(group, c, p, 7, "x") for c, p in pairs], SCHEMA)


def test_chain_longer_than_many_rounds(spark):
    tree = unroll(edges(spark, [(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, 40)])).collect()
    by = {r.node: r for r in tree}
    assert by["n039"].depth == 39 and by["n039"].root == "n000" and by["n039"].path == "/".join(f"n{i:03d}" for i in range(40))


def test_cycles_self_loops_and_what_hangs_below(spark):
    tree = unroll(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s"), ("t", "s"), ("y", "x")]))
    got = {r.node: (r.root, r.depth, r.path) for r in tree.collect()}
    assert got == {n: ("CYCLE", -1, None) for n in "abcdst"} | {"x": ("x", 0, "x"), "y": ("x", 1, "x/y")}


def test_random_forest_against_walking_up(spark):
    rng = random.Random(5)
    parent = {f"n{i}": f"n{rng.randrange(max(0, i - 6), i)}" for i in range(1, 200) if rng.random() < 0.95}
    tree = unroll(edges(spark, list(parent.items()) * 2))
    want = {}
    for node in set(parent) | set(parent.values()):
        path = [node]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        want[node] = (path[-1], len(path) - 1, "/".join(reversed(path)))
    assert {r.node: (r.root, r.depth, r.path) for r in tree.collect()} == want
    pairs = sorted((r.ancestor, r.descendant, r.distance) for r in descendants(tree).collect())
    assert pairs == sorted((a, n, len(p) - 1 - i) for n, (_, _, path) in want.items() for p in [path.split("/")] for i, a in enumerate(p[:-1]))
    assert sum(r.n_descendants for r in descendant_counts(tree).collect()) == len(pairs)


def test_nulls_groups_and_empty(spark):
    df = spark.createDataFrame([("g", "a", "b", 1, ""), ("h", "b", "a", 1, ""), ("g", None, "z", 1, ""), (None, "a", "b", 1, ""), ("g", "q", None, 1, "")], SCHEMA)
    assert sorted((r.grp, r.node, r.depth) for r in unroll(df, with_path=False).collect()) == [("g", "a", 1), ("g", "b", 0), ("h", "a", 0), ("h", "b", 1)]
    assert unroll(edges(spark, [])).count() == 0


def test_two_parents_take_the_smallest(spark):
    assert {r.node: r.root for r in unroll(edges(spark, [("a", "z"), ("a", "b")])).collect()} == {"a": "b", "b": "b"}


def test_shuffled_joins_give_the_same_tree(spark, monkeypatch):
    from knotwork.operators import hierarchy

    rows = [("g", f"n{i}", f"n{i - 1}") for i in range(1, 60)] + [("g", f"m{i}", f"n{i % 7}") for i in range(40)] + [("g", "x", "y"), ("g", "y", "x")]
    df = spark.createDataFrame(rows, "grp string, child string, parent string")
    small = sorted(map(tuple, hierarchy.unroll(df).collect()), key=str)
    monkeypatch.setattr(hierarchy, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, hierarchy.unroll(df).collect()), key=str) == small
    assert max(r[3] for r in small) == 59
