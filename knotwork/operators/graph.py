"""Weighted graphs, communities and partitions as edge lists and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.vectors import dot
from knotwork.session import Workspace


def edge_similarity(edges: DataFrame, vecs: DataFrame) -> DataFrame:
    """``src, dst, sim`` of every edge row; null where an end has no vector (``vecs``: id, vec of unit length)."""
    a, b = vecs.select(F.col("id").alias("src"), F.col("vec").alias("va")), vecs.select(F.col("id").alias("dst"), F.col("vec").alias("vb"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", dot(F.col("va"), F.col("vb")).alias("sim"))


def weighted_graph(edges: DataFrame, vecs: DataFrame, power: int = 2, shift: float = 1e-4, always: bool = False) -> DataFrame:
    """Undirected ``u, v, w`` with ``u < v``: similarities shifted above zero if any is not (or ``always``), raised to ``power``, summed.

    Edges without both vectors get the weight of the lowest similarity. Loops are dropped.
    """
    sims = edge_similarity(edges.where("src <> dst"), vecs).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.round("sim", 9).alias("sim"))
    lowest = sims.agg(F.min("sim").alias("m")).select("m").scalar()
    moved = F.coalesce("sim", lowest) + (F.abs(lowest) + shift if always else F.when(lowest <= 0, F.abs(lowest) + shift).otherwise(0.0))
    return sims.groupBy("u", "v").agg(F.sum(F.pow(moved, F.lit(power))).alias("w"))


def adjacency(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of labels joined by an edge, with the number of edges; ``labels``: id, pid."""
    la, lb = labels.select(F.col("id").alias("src"), F.col("pid").alias("pa")), labels.select(F.col("id").alias("dst"), F.col("pid").alias("pb"))
    both = edges.join(la, "src").join(lb, "dst").where("pa <> pb")
    return both.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.count(F.lit(1)).alias("n_edges"))


def modularity(graph: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row ``modularity``: sum over labels of inner weight share minus gamma times the squared degree share."""
    lu, lv = labels.select(F.col("id").alias("u"), F.col("pid").alias("pu")), labels.select(F.col("id").alias("v"), F.col("pid").alias("pv"))
    e = graph.join(lu, "u").join(lv, "v")
    ends = e.select(F.explode(F.array(F.struct(F.col("pu").alias("p"), F.col("w"), F.when(F.col("pu") == F.col("pv"), F.col("w")).otherwise(0.0).alias("inner")), F.struct(F.col("pv").alias("p"), F.col("w"), F.lit(0.0).alias("inner")))).alias("x"))
    per = ends.groupBy("x.p").agg(F.sum("x.w").alias("total"), F.sum("x.inner").alias("inner"))
    m2 = per.agg(F.sum("total")).scalar()
    return per.agg(F.sum(2 * F.col("inner") / m2 - gamma * F.pow(F.col("total") / m2, F.lit(2))).alias("modularity"))


def balance(sizes: DataFrame, cap: int) -> DataFrame:
    """One row of balance figures of ``sizes`` (pid, size): spread, quantiles, imbalance and compliance with a cap."""
    k, total, top = F.count(F.lit(1)), F.sum("size"), F.max("size")
    q = lambda p: F.round(F.expr(f"percentile(size, {p})"), 6)
    return sizes.agg(
        k.alias("k"), total.alias("total"), F.round(F.avg("size"), 6).alias("mean"), F.min("size").alias("min"), q(0.5).alias("median"), F.round(F.stddev_samp("size"), 6).alias("stdev"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99"),
        top.alias("max"), F.round(top / F.avg("size"), 6).alias("load"), F.round(k * top / total - 1, 6).alias("imbalance"), F.count_if(F.col("size") > cap).alias("n_over"),
    )


def gini(sizes: DataFrame) -> DataFrame:
    """One row ``gini``; computed over distinct sizes with their counts, so equal sizes never meet in one sort."""
    per = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("before", before)
    weighted = F.sum(F.col("size") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2))
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("size"))
    return ranked.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * weighted / (n * total) - (n + 1) / n)).alias("gini"))


def capped_assignment(candidates: DataFrame, free: DataFrame) -> DataFrame:
    """``id, pid, sim``: every item to the best of its candidates that still has room, else to its best (``overflow``).

    ``candidates``: id, pid, sim; ``free``: pid, room. In each round all unplaced items propose to their best
    candidate with room; a partition accepts the most similar (ties to the smaller id) up to its room. Each round
    fills a partition or places everyone, and only partitions with room stay; rounds go on until one places nobody.
    """
    spark = candidates.sparkSession
    work = Workspace(spark, "assign")
    everyone, room = work.write(candidates.select("id", "pid", "sim"), "candidates"), work.write(free.select("pid", F.col("room").cast("bigint").alias("room")), "room")
    order = Window.partitionBy("pid").orderBy(F.desc("sim"), "id")
    rounds: list[str] = []
    done, open_, left = None, everyone, room
    while True:
        met = open_.join(left.where("room > 0"), "pid")
        proposal = met.groupBy("id").agg(F.min_by(F.struct("pid", "sim", "room"), F.struct(-F.col("sim"), F.col("pid"))).alias("p")).select("id", "p.*")
        taken = work.write(proposal.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("room")).select("id", "pid", "sim"), "taken")
        if taken.isEmpty():
            break
        rounds.append(taken._knotwork_path)
        done = spark.read.schema(taken.schema).parquet(*rounds)
        used = done.groupBy("pid").agg(F.count(F.lit(1)).alias("used"))
        left = room.join(used, "pid", "left").select("pid", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
        open_ = everyone.join(done.select("id"), "id", "left_anti")
    nearest = open_.groupBy("id").agg(F.min_by(F.struct("pid", "sim"), F.struct(-F.col("sim"), F.col("pid"))).alias("p")).select("id", "p.pid", "p.sim", F.lit(True).alias("overflow"))
    return nearest if done is None else done.withColumn("overflow", F.lit(False)).unionByName(nearest)


def communities(graph: DataFrame, gamma: float = 3.0, levels: int = 2, sweeps: int = 6) -> DataFrame:
    """``id, label``: communities by local moves that gain modularity at resolution ``gamma``, then merged levels.

    In each sweep every node weighs the labels of its neighbours by ``weight to label - gamma * degree * label degree / 2m``
    and half of the nodes, chosen by a hash of node and sweep, move if another label gains; so no two swap for ever. After
    the sweeps labels become nodes. Labels are node ids, so the outcome is the same whatever the partitioning. Communities
    are finally cut into their connected parts.
    """
    work = Workspace(graph.sparkSession, "communities")
    e = work.write(graph.select("u", "v", F.col("w").cast("double").alias("w")), "edges")
    mapping = None
    for level in range(levels):
        both = work.write(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")) if level == 0 else e.unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "both")
        degree = work.write(both.groupBy("u").agg(F.sum("w").alias("k")), "degree")
        m2 = float(degree.agg(F.sum("k")).first()[0] or 0.0)
        if not m2:
            break
        label = degree.select(F.col("u").alias("id"), F.col("u").alias("label"), "k")
        for sweep in range(sweeps):
            total = label.groupBy("label").agg(F.sum("k").alias("total"))
            links = both.where("u <> v").join(label.select(F.col("id").alias("v"), F.col("label").alias("to")), "v").groupBy("u", "to").agg(F.sum("w").alias("w"))
            own = label.select(F.col("id").alias("u"), "label", "k", F.col("label").alias("to"), F.lit(0.0).alias("w"))
            options = links.join(label.select(F.col("id").alias("u"), "label", "k"), "u").select("u", "label", "k", "to", "w").unionByName(own).groupBy("u", "label", "k", "to").agg(F.sum("w").alias("w"))
            scored = options.join(total.withColumnRenamed("label", "to"), "to").withColumn("gain", F.round(F.col("w") - gamma * F.col("k") * (F.col("total") - F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(0.0)) / m2, 9))
            choice = scored.groupBy("u", "label", "k").agg(F.max_by("to", F.struct("gain", F.when(F.col("to") == F.col("label"), 1).otherwise(0), F.col("to"))).alias("to"))
            may = F.pmod(F.xxhash64(F.col("u"), F.lit(sweep)), F.lit(2)) == 0
            label = work.write(choice.select(F.col("u").alias("id"), F.when(may, F.col("to")).otherwise(F.col("label")).alias("label"), "k"), "labels")
        names = label.select("id", "label")
        mapping = names if mapping is None else work.write(mapping.withColumnRenamed("label", "mid").join(names.withColumnRenamed("id", "mid"), "mid").select("id", "label"), "mapping")
        if level < levels - 1:
            lifted = e.join(names.select(F.col("id").alias("u"), F.col("label").alias("lu")), "u").join(names.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
            e = work.write(lifted.groupBy(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).agg(F.sum("w").alias("w")), "edges")
    if mapping is None:
        return graph.select(F.col("u").alias("id"), F.col("u").alias("label"))
    inside = graph.join(mapping.select(F.col("id").alias("u"), F.col("label").alias("lu")), "u").join(mapping.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v").where("lu = lv").select("u", "v")
    part = components(inside, mapping.select("id"))
    return mapping.join(part, "id").select("id", F.col("component").alias("label"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, component``: the smallest id of each connected part of ``edges`` (u, v) over ``nodes`` (id).

    Each round takes the least label among the neighbours and then jumps to the label's own label, so that chains
    shorten by more than one step a round; rounds go on until no label changes.
    """
    work = Workspace(nodes.sparkSession, "components")
    both = work.write(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    label = work.write(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    changed = True
    while changed:
        near = both.join(label.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.alias("a").join(step.select(F.col("id").alias("jid"), F.col("component").alias("jc")), F.col("a.component") == F.col("jid"), "left")
        after = work.write(jump.select("id", "old", F.least("component", F.coalesce("jc", "component")).alias("component")), "labels")
        changed = not after.where("old <> component").isEmpty()
        work.drop(label)
        label = after
    work.drop(both)
    return label.select("id", "component")


def merge_rounds(sizes: DataFrame, links: DataFrame, least: int, caps: tuple[int | None, ...], movers: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``pid, into``: every partition with the one it ends in, after partitions below ``least`` have merged as long as any can.

    ``sizes``: pid, size; ``links``: a, b, weight. In each round every small partition (of ``movers``: pid, if given) offers itself to
    the partition it shares most weight with, small or not, whose size is below the cap; ties go to the smaller labels. An
    offer counts if its target makes none itself, or if both offer to each other (then the smaller one moves), and a
    target takes offers in the order of size and label while it is below the cap (``strict``: while the sum stays within it). Sizes and links
    follow the new labels. When a round merges nothing the next of the rising ``caps`` holds; None is no cap.
    """
    work = Workspace(sizes.sparkSession, "merge")
    sizes = work.write(sizes.select("pid", "size"), "sizes")
    links = work.write(links.select("a", "b", F.col("weight").cast("double").alias("weight")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").cast("double").alias("weight"))), "links")
    mapping = work.write(sizes.select("pid", F.col("pid").alias("into")), "mapping")
    at = 0
    while at < len(caps):
        cap = caps[at]
        now = sizes.join(mapping, "pid").groupBy(F.col("into").alias("pid")).agg(F.sum("size").alias("size"))
        small = now.where(F.col("size") < least)
        if movers is not None:
            small = small.join(movers.select("pid"), "pid", "left_semi")
        ends = links.join(mapping.select(F.col("pid").alias("a"), F.col("into").alias("pid")), "a").join(mapping.select(F.col("pid").alias("b"), F.col("into").alias("to")), "b")
        shared = ends.where("pid <> to").groupBy("pid", "to").agg(F.sum("weight").alias("weight"))
        fits = shared.join(small, "pid").join(now.select(F.col("pid").alias("to"), F.col("size").alias("held")), "to")
        if cap is not None:
            fits = fits.where((F.col("size") + F.col("held") <= cap) if strict else (F.col("held") < cap))
        best = F.struct("weight", -F.least("pid", "to"), -F.greatest("pid", "to"))
        offer = work.write(fits.groupBy("pid", "size").agg(F.max_by(F.struct("to", "held"), best).alias("t")).select("pid", "size", "t.*"), "offers")
        back = offer.select(F.col("pid").alias("to"), F.col("to").alias("theirs"), F.col("size").alias("their_size"))
        counts = offer.join(back, "to", "left").where("theirs IS NULL OR (theirs = pid AND (size < their_size OR (size = their_size AND pid > to)))")
        upto = F.sum("size").over(Window.partitionBy("to").orderBy("size", "pid"))
        taken = counts.withColumn("upto", upto)
        if cap is not None:
            taken = taken.where((F.col("held") + F.col("upto") <= cap) if strict else (F.col("held") + F.col("upto") - F.col("size") < cap))
        taken = work.write(taken.select(F.col("pid").alias("into"), "to"), "taken")
        work.drop(offer)
        if taken.isEmpty():
            at += 1
            continue
        after = work.write(mapping.join(taken, "into", "left").select("pid", F.coalesce("to", "into").alias("into")), "mapping")
        work.drop(mapping)
        work.drop(taken)
        mapping = after
    work.drop(links)
    work.drop(sizes)
    return mapping


def split_oversized(labels: DataFrame, cap: int) -> DataFrame:
    """``id, pid, part``: partitions above the cap cut into ``ceil(size / cap)`` even parts by the MD5 of the id; part 0 keeps the label."""
    sizes = labels.groupBy("pid").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / cap).cast("int")
    return labels.join(sizes, "pid").select("id", "pid", F.when(F.col("size") > cap, F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % parts).otherwise(0).cast("int").alias("part"))


def merge_small(sizes: DataFrame, adjacent: DataFrame, least: int, cap: int) -> DataFrame:
    """``pid, into``: partitions below ``least`` join the adjacent partition with most shared edges that stays within the cap.

    ``sizes``: pid, size; ``adjacent``: a, b, n_edges. One round: a small partition proposes to its best neighbour that is
    not small itself (ties to the smaller label); the neighbour accepts in order of size and label while it has room.
    """
    pairs = adjacent.select(F.col("a").alias("pid"), F.col("b").alias("into"), "n_edges").unionByName(adjacent.select(F.col("b").alias("pid"), F.col("a").alias("into"), "n_edges"))
    small = sizes.where(F.col("size") < least)
    target = sizes.where(F.col("size") >= least).select(F.col("pid").alias("into"), F.col("size").alias("held"))
    fits = pairs.join(small, "pid").join(target, "into").where(F.col("size") + F.col("held") <= cap)
    offer = fits.groupBy("pid", "size").agg(F.max_by(F.struct("into", "held"), F.struct("n_edges", -F.col("into"))).alias("t")).select("pid", "size", "t.*")
    upto = F.sum("size").over(Window.partitionBy("into").orderBy("size", "pid"))
    return offer.withColumn("upto", upto).where(F.col("upto") + F.col("held") <= cap).select("pid", "into")


def merge_isolated(sizes: DataFrame, adjacent: DataFrame, near: DataFrame, least: int, cap: int) -> DataFrame:
    """``pid, into``: small partitions without any adjacent one join the most similar of their nearest that fits the cap.

    ``near``: pid, other, sim, the nearest partitions by centroid.
    """
    touched = adjacent.select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    alone = sizes.where(F.col("size") < least).join(touched, "pid", "left_anti")
    target = sizes.select(F.col("pid").alias("other"), F.col("size").alias("held"))
    fits = alone.join(near, "pid").join(target, "other").where(F.col("size") + F.col("held") <= cap)
    return fits.groupBy("pid").agg(F.max_by("other", F.struct("sim", -F.col("other"))).alias("into"))
