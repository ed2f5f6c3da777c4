"""Parent-child links unrolled into paths, depths, roots, descendants and cycles.

From the roots down the frontier of reached nodes is joined to the links not used yet. Links are first
widened to the nearest 8 ancestors, so that one join reaches 8 levels; a round ends in a table in the
shared folder, and reached nodes leave the rest, so that later rounds move only what hangs deeper.
Nodes that no root reaches sit in or below a cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.session import Workspace

CYCLE = "CYCLE"
#: Sides of at most so many rows (ids and eight ancestors, some 2 MB) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 5_000


def _side(df: DataFrame, n_rows: int) -> DataFrame:
    """A side of a join by its counted rows: files of ids pack well, so their size alone would mislead Spark."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df.hint("merge")


def links(df: DataFrame, group: Column, child: Column, parent: Column) -> DataFrame:
    """Distinct links ``grp, child, parent`` without nulls."""
    return df.select(group.alias("grp"), child.alias("child"), parent.alias("parent")).where("grp is not null and child is not null and parent is not null").distinct()


def _hops(edges: DataFrame, n_rows: int, doublings: int) -> DataFrame:
    """Adds ``up``: the nearest ``2 ** doublings`` ancestors of ``child``, nearest first, fewer where a root comes before."""
    out = edges.select("grp", "child", F.array("parent").alias("up"))
    for i in range(doublings):
        above = out.select("grp", F.col("child").alias("top"), F.col("up").alias("more"))
        out = (
            out.withColumn("top", F.when(F.size("up") == 2**i, F.element_at("up", -1)))
            .join(_side(above, n_rows), ["grp", "top"], "left")
            .select("grp", "child", F.when(F.col("more").isNull(), F.col("up")).otherwise(F.concat("up", "more")).alias("up"))
        )
    return out


def unroll(edges: DataFrame, with_path: bool = True, doublings: int = 3, separator: str = "/") -> DataFrame:
    """One row per node of every group: ``grp, node, root, depth`` and, if asked for, ``path`` from the root to the node.

    ``edges`` has ``grp, child, parent``; each child has at most one parent in its group (a child with several
    takes the smallest, so that the result is defined). Roots have depth 0 and themselves as root; nodes whose way up
    never ends (self-loops included) have root ``CYCLE``, depth -1 and a null path. Null ids are dropped, repeated links
    count once, an empty table gives an empty result, and other columns are ignored.
    """
    work = Workspace(edges.sparkSession, "hierarchy")
    hops = 2**doublings
    clean = edges.select("grp", "child", "parent").where("grp is not null and child is not null and parent is not null")
    parents = work.write(clean.groupBy("grp", "child").agg(F.min("parent").alias("parent")), "links")
    n_left = parents.count()
    roots = (
        parents.select("grp", F.col("parent").alias("node")).distinct()
        .join(_side(parents.select("grp", F.col("child").alias("node")), n_left), ["grp", "node"], "left_anti")
        .select("grp", "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), (F.col("node") if with_path else F.lit(None).cast("string")).alias("path"))
    )
    roots = work.write(roots, "roots")
    state = _hops(parents, n_left, doublings).select("grp", "child", "up", *[F.lit(None).cast(kind).alias(name) for name, kind in (("root", "string"), ("depth", "bigint"), ("path", "string"))])
    start = work.write(state, "rest")
    rest, frontier, n_frontier, depth, written = start, roots, roots.count(), 0, []
    while True:
        # Each node between one and `hops` levels below the frontier has exactly one ancestor in it.
        near = rest.select("grp", "child", "up", F.posexplode("up").alias("i", "node"))
        between = F.reverse(F.slice("up", F.lit(1), F.col("i")))
        onward = F.concat_ws(separator, F.col("f.path"), F.array_append(between, F.col("child"))) if with_path else F.lit(None).cast("string")
        found = near.join(_side(frontier, n_frontier).alias("f"), ["grp", "node"]).select("grp", "child", F.col("f.root").alias("root"), (F.col("f.depth") + F.col("i") + 1).alias("depth"), onward.alias("path"))
        state = work.write(rest.select("grp", "child", "up").join(_side(found, n_left), ["grp", "child"], "left"), "state")
        written.append(state._knotwork_path)
        deepest, n_left = state.agg(F.max("depth"), F.count_if(F.col("depth").isNull())).first()
        rest = state.where("depth is null")
        if deepest is None or deepest < depth + hops or not n_left:
            break
        depth = int(deepest)
        frontier = state.where(F.col("depth") == depth).select("grp", F.col("child").alias("node"), "root", "depth", "path")
        n_frontier = frontier.count()
    work.drop(start)
    # The tables of all rounds are one scan, however deep the hierarchy.
    reached = edges.sparkSession.read.schema(state.schema).parquet(*written).where("depth is not null")
    tree = roots.unionByName(reached.select("grp", F.col("child").alias("node"), "root", "depth", "path"))
    lost = rest.select("grp", F.col("child").alias("node"), F.lit(CYCLE).alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("path"))
    out = tree.unionByName(lost)
    return out if with_path else out.drop("path")


def descendants(tree: DataFrame, separator: str = "/") -> DataFrame:
    """Ancestor pairs of an unrolled hierarchy with paths: ``grp, ancestor, descendant, distance`` (at least 1).

    Ids must not hold the separator. Nodes in or below cycles have no ancestors here.
    """
    steps = F.split("path", F.lit(separator))
    return (
        tree.where("depth > 0")
        .select("grp", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice(steps, 1, F.size(steps) - 1)).alias("level", "ancestor"))
        .select("grp", "ancestor", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
    )


def descendant_counts(tree: DataFrame, separator: str = "/") -> DataFrame:
    """``grp, node, n_descendants, height`` of every node that has descendants."""
    return descendants(tree, separator).groupBy("grp", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))
