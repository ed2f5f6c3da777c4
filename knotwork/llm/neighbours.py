"""Most similar vectors for every vector: NN-descent over Spark joins, searched greedily.

A first graph comes from ``trees`` orderings of the vectors by the signs of random projections: the
ordering is cut into blocks of ``block`` vectors, whatever the sizes of its cells, and each block is
compared within itself. NN-descent then joins neighbours of neighbours: every vector brings its
neighbours and reverse neighbours together, they are compared with each other, and a pair is passed
on only if it beats the worst neighbour that one of its ends has. Equal vectors are one node; the
copies come back at the end.

What NN-descent keeps per vector is bounded (``width`` neighbours, as many reverse ones); what that
costs is measured by ``recall`` against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.vectors import best, products, unit
from knotwork.session import Workspace, shuffle_partitions

PAIRS = "src bigint, nb array<struct<dst:bigint,sim:double,fresh:boolean>>"
NB = pa.list_(pa.struct([("dst", pa.int64()), ("sim", pa.float64()), ("fresh", pa.bool_())]))
DECIMALS = 10


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1) if n else flat.reshape(0, 1)
    # Scaled by the largest entry first, so that no square under- or overflows.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True) if n else rows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) if n else rows


def _best(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, fresh: np.ndarray, k: int) -> pa.Table:
    """The k best distinct ``dst`` of each ``src``: most similar first, ties to the smaller id; a known pair stays known."""
    order = np.lexsort((fresh, dst, src))
    src, dst, sim, fresh = src[order], dst[order], sim[order], fresh[order]
    first = np.ones(len(src), bool)
    first[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, sim, fresh = src[first], dst[first], sim[first], fresh[first]
    order = np.lexsort((dst, -sim, src))
    src, dst, sim, fresh = src[order], dst[order], sim[order], fresh[order]
    starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, int)
    rank = np.arange(len(src)) - np.repeat(starts, np.diff(np.r_[starts, len(src)]))
    keep = rank < k
    src, dst, sim, fresh = src[keep], dst[keep], sim[keep], fresh[keep]
    starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, int)
    items = pa.StructArray.from_arrays([pa.array(dst), pa.array(sim), pa.array(fresh)], names=["dst", "sim", "fresh"])
    nb = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(src)].astype(np.int32)), items)
    return pa.table({"src": pa.array(src[starts]), "nb": nb})


def _blocks(batches: Iterator[pa.RecordBatch], block: int, k: int) -> Iterator[pa.RecordBatch]:
    """Compares consecutive rows ``tree, id, vec`` in blocks; a block never crosses a tree."""

    def compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = part["id"].to_numpy()
        unit = _matrix(part["vec"])
        sims = np.round(unit @ unit.T, DECIMALS)
        np.fill_diagonal(sims, -2)
        k_here = min(k, len(ids) - 1)
        if k_here < 1:
            return
        top = np.argpartition(-sims, k_here - 1, axis=1)[:, :k_here]
        src = np.repeat(ids, k_here)
        yield from _best(src, ids[top].ravel(), np.take_along_axis(sims, top, 1).ravel(), np.ones(len(src), bool), k).to_batches()

    held: list[pa.Table] = []
    n_held = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n_held += batch.num_rows
        if n_held < 4 * block:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        upto = 0
        trees = rows["tree"].to_numpy()
        while n_held - upto >= 2 * block:
            stop = upto + min(block, int(np.searchsorted(trees[upto : upto + block], trees[upto], side="right")))
            yield from compare(rows.slice(upto, stop - upto))
            upto = stop
        held, n_held = [rows.slice(upto)], n_held - upto
    if n_held:
        rows = pa.concat_tables(held).combine_chunks()
        trees = rows["tree"].to_numpy()
        upto = 0
        while upto < n_held:
            stop = upto + min(block, int(np.searchsorted(trees[upto : upto + block], trees[upto], side="right")))
            yield from compare(rows.slice(upto, stop - upto))
            upto = stop


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows ``src, nbs`` (list of lists of pairs) to the k best of each ``src``."""
    for batch in batches:
        outer = batch["nbs"]
        inner = outer.flatten()
        pairs = inner.flatten()
        lists = np.repeat(batch["src"].to_numpy(), outer.value_lengths().to_numpy())
        src = np.repeat(lists, inner.value_lengths().to_numpy())
        yield from _best(src, pairs.field("dst").to_numpy(), pairs.field("sim").to_numpy(), pairs.field("fresh").to_numpy(zero_copy_only=False), k).to_batches()


def _local_join(batches: Iterator[pa.RecordBatch], group_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows ``v, u, vec, bound, fresh`` in the order of v: compares the u of each v; yields pairs that beat a bound."""

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        v = rows["v"].to_numpy()
        starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        sizes = np.diff(np.r_[starts, len(v)])
        u, bound = rows["u"].to_numpy(), rows["bound"].to_numpy()
        fresh = rows["fresh"].to_numpy(zero_copy_only=False)
        unit = _matrix(rows["vec"])
        out = []
        for size in np.unique(sizes):
            at = starts[sizes == size][:, None] + np.arange(size)
            for cut in range(0, len(at), 4096):
                x = at[cut : cut + 4096]
                sims = np.round(unit[x] @ unit[x].transpose(0, 2, 1), DECIMALS)
                ids, f = u[x], fresh[x]
                good = (sims >= bound[x][:, :, None]) & (ids[:, :, None] != ids[:, None, :]) & (f[:, :, None] | f[:, None, :])
                g, a, b = np.nonzero(good)
                out.append((ids[g, a], ids[g, b], sims[g, a, b]))
        src, dst, sim = (np.concatenate(c) for c in zip(*out))
        yield from _best(src, dst, sim, np.ones(len(src), bool), 1 << 30).to_batches()

    held: list[pa.Table] = []
    n_held = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        n_held += batch.num_rows
        if n_held < group_rows:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        v = rows["v"].to_numpy()
        upto = int(np.searchsorted(v, v[-1]))
        if upto:
            yield from compare(rows.slice(0, upto))
        held, n_held = [rows.slice(upto)], n_held - upto
    if n_held:
        yield from compare(pa.concat_tables(held).combine_chunks())


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec``: rows with a key and a finite vector that is not all zero, of the length that most vectors have."""
    vec = df[vector].cast("array<double>")
    sound = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = df.select(df[key].cast("bigint").alias("id"), df[vector].alias("vec")).where(sound & df[key].isNotNull())
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))


class Graph:
    """A neighbour graph: ``nodes`` (id, vec; one per distinct vector), ``edges`` (src, nb) and ``copies`` (node, id)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, copies: DataFrame, rounds: int):
        self.nodes, self.edges, self.copies, self.rounds = nodes, edges, copies, rounds


def build(df: DataFrame, key: str, vector: str, width: int = 14, trees: int = 10, block: int = 512, bits: int = 30, settled: float = 0.002, seed: int = 7) -> Graph:
    spark = df.sparkSession
    work = Workspace(spark, "neighbours")
    rows = usable(df, key, vector)
    # One node per distinct vector: its smallest id. Copies join by the vector itself.
    ranked = rows.withColumn("h", F.xxhash64("vec"))
    nodes_h = work.write(ranked.groupBy("h", "vec").agg(F.min("id").alias("id")), "nodes")
    copies = work.write(ranked.select("h", "vec", F.col("id").alias("copy")).join(nodes_h, ["h", "vec"]).select(F.col("id").alias("node"), F.col("copy").alias("id")), "copies")
    nodes = nodes_h.select("id", "vec")
    size = nodes.select(F.size("vec")).first()
    if size is None:
        return Graph(nodes, spark.createDataFrame([], PAIRS), copies, 0)
    planes = np.random.default_rng(seed).standard_normal((size[0], trees * bits))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits - 1, -1, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = (_matrix(batch["vec"]) @ planes > 0).reshape(-1, trees, bits) @ weights
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(signs[:, t].astype(np.int64)), batch["id"], batch["vec"]], names=["tree", "code", "id", "vec"])

    kind = nodes.schema["vec"].dataType.simpleString()
    parts = shuffle_partitions(spark)
    coded = work.write(nodes.mapInArrow(codes, f"tree int, code bigint, id bigint, vec {kind}"), "codes")
    lined = coded.repartitionByRange(parts, "tree", "code", "id").sortWithinPartitions("tree", "code", "id")
    first = lined.mapInArrow(lambda it: _blocks(it, block, width), PAIRS)
    gather = lambda e: e.groupBy("src").agg(F.collect_list("nb").alias("nbs")).mapInArrow(lambda it: _merge(it, width), PAIRS)
    edges = work.write(gather(first), "graph")
    work.drop(coded)
    n_nodes = nodes.count()
    rounds = 0
    while True:
        flat = edges.select("src", F.inline("nb"))
        order = Window.partitionBy("dst").orderBy(F.desc("sim"), "src")
        back = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)
        around = flat.select(F.col("src").alias("v"), F.col("dst").alias("u"), "fresh").unionByName(back.select(F.col("dst").alias("v"), F.col("src").alias("u"), "fresh"))
        around = around.groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        bounds = edges.select(F.col("src").alias("u"), F.when(F.size("nb") < width, F.lit(-1.0)).otherwise(F.element_at("nb", -1)["sim"]).alias("bound"))
        carried = nodes.withColumnRenamed("id", "u").join(bounds, "u")
        met = around.join(carried, "u").select("v", "u", "vec", "bound", "fresh").repartition(parts, "v").sortWithinPartitions("v")
        better = met.mapInArrow(lambda it: _local_join(it, 20_000), PAIRS)
        old = edges.select("src", F.transform("nb", lambda x: F.struct(x["dst"].alias("dst"), x["sim"].alias("sim"), F.lit(False).alias("fresh"))).alias("nb"))
        after = work.write(gather(old.unionByName(better)), "graph")
        changed = after.select(F.inline("nb")).where("fresh").count()
        work.drop(edges)
        edges = after
        rounds += 1
        if changed <= settled * width * n_nodes:
            break
    return Graph(nodes, edges, copies, rounds)


def nearest(graph: Graph, k: int) -> DataFrame:
    """``id, neighbour, sim, rank``: the k nearest others of every row, equal vectors included; ties to the smaller id.

    Of each group of equal vectors only the ``k + 1`` smallest ids can be anyone's neighbour, and only those are brought
    to the neighbours of the group.
    """
    order = Window.partitionBy("node").orderBy("id")
    offered = graph.copies.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select(F.col("node").alias("dst"), F.col("id").alias("neighbour"))
    pairs = graph.edges.select("src", F.inline("nb")).select("src", "dst", "sim").unionByName(graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("sim")))
    best = Window.partitionBy("src").orderBy(F.desc("sim"), "neighbour")
    lists = pairs.join(offered, "dst").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = lists.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("nth", "neighbour", "sim"))).alias("list"))
    own = graph.copies.join(lists.withColumnRenamed("src", "node"), "node")
    others = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return own.select("id", F.posexplode(others).alias("pos", "x")).select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.sim").alias("sim"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(near: DataFrame, least: float) -> DataFrame:
    """Distinct pairs ``a < b`` with at least the given similarity in which one is among the nearest of the other."""
    return near.where(F.col("sim") >= least).select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def brute_force(df: DataFrame, key: str, vector: str, k: int, every: int = 100) -> DataFrame:
    """``id, neighbour, sim, rank`` of the rows whose key is divisible by ``every``, against all rows, in blocks of matrix products."""
    rows = usable(df, key, vector).select("id", unit(F.col("vec")).alias("vec"))
    met = products(rows.where(F.col("id") % every == 0).withColumnRenamed("id", "qid"), rows, keep=k + 1, decimals=DECIMALS).drop("rank")
    near = best(met.where("qid <> id"), k)
    return near.select(F.col("qid").alias("id"), F.col("id").alias("neighbour"), F.col("score").alias("sim"), "rank")


def recall(near: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``n_true`` neighbours of the queries in ``truth``, ``n_hit`` of them found, and ``recall``."""
    hit = truth.select("id", "neighbour").join(near.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_hit")).withColumn("recall", F.try_divide(F.col("n_hit"), F.col("n_true")))


def search(graph: Graph, queries: DataFrame, k: int = 10, beam: int = 32, entries: int = 1024, seed: int = 11) -> DataFrame:
    """``id, neighbour, sim, rank``: greedy search of the graph for every query (``id bigint, vec``).

    Each query starts at its ``beam`` nearest of ``entries`` nodes, a bounded sample drawn by hash, and in each step
    expands the nodes of its beam that it has not expanded yet along their edges in both directions; it ends when a step
    leaves the beam as it was. The state of a query is its beam alone. A query's own row does not count as its neighbour; equal
    vectors are expanded to their copies at the end, ties go to the smaller id.
    """
    spark = graph.nodes.sparkSession
    work = Workspace(spark, "search")
    asked = work.write(usable(queries, "id", "vec"), "queries")
    flat = graph.edges.select("src", F.inline("nb")).select("src", "dst")
    links = work.write(flat.unionByName(flat.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    start = graph.nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(entries).collect()
    if not start:
        return spark.createDataFrame([], "id bigint, neighbour bigint, sim double, rank int")
    e_ids, e_unit = np.array([r["id"] for r in start]), np.array([r["vec"] for r in start], dtype=np.float64)
    e_unit /= np.linalg.norm(e_unit, axis=1, keepdims=True)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = np.round(_matrix(batch["vec"]) @ e_unit.T, DECIMALS)
                src = np.repeat(batch["id"].to_numpy(), len(e_ids))
                yield from _best(src, np.tile(e_ids, batch.num_rows), sims.ravel(), np.ones(len(src), bool), beam).to_batches()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = np.round(np.einsum("ij,ij->i", _matrix(batch["qvec"]), _matrix(batch["vec"])), DECIMALS)
                yield from _best(batch["src"].to_numpy(), batch["dst"].to_numpy(), sims, np.ones(len(sims), bool), beam).to_batches()

    qvec, nvec = asked.select(F.col("id").alias("src"), F.col("vec").alias("qvec")), graph.nodes.select(F.col("id").alias("dst"), "vec")
    gather = lambda e: e.groupBy("src").agg(F.collect_list("nb").alias("nbs")).mapInArrow(lambda it: _merge(it, beam), PAIRS)
    kind = asked.schema["vec"].dataType.simpleString()
    state = work.write(asked.mapInArrow(enter, PAIRS), "beam")
    while True:
        flat_state = state.select("src", F.inline("nb"))
        fresh = flat_state.where("fresh").select("src", F.col("dst").alias("via"))
        seen = flat_state.select("src", "dst")
        reached = fresh.join(links.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct().join(seen, ["src", "dst"], "left_anti")
        rated = reached.join(qvec, "src").join(nvec, "dst").select("src", "dst", F.col("qvec").cast(kind).alias("qvec"), "vec").mapInArrow(rate, PAIRS)
        old = state.select("src", F.transform("nb", lambda x: F.struct(x["dst"].alias("dst"), x["sim"].alias("sim"), F.lit(False).alias("fresh"))).alias("nb"))
        after = work.write(gather(old.unionByName(rated)), "beam")
        work.drop(state)
        state = after
        if state.select(F.inline("nb")).where("fresh").isEmpty():
            break
    copies = graph.copies.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("nth") <= k + 1).select(F.col("node").alias("dst"), F.col("id").alias("neighbour"))
    found = state.select(F.col("src").alias("id"), F.inline("nb")).join(copies, "dst").where("id <> neighbour")
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "neighbour", "sim", "rank")
