"""Queries of graph building, partitioning and partition figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import graph as G
from knotwork.operators import kg, vectors
from knotwork.operators.audit import HUB_RELATIONS
from knotwork.plans.retrieval import CEN, centroid_vectors, hashed
from knotwork.plans.sqlparts import EDGES, ENT, MEM
from knotwork.plans.text import EMBED, PREMISES, _tok
from knotwork.sources import table

QUERIES, SQL = {}, {}
CAP, LEAST, CENTROIDS, COARSE_CELLS, COARSE_PROBES = 60, 4, 100, 256, 96
CAP_LADDER = (60, 78, 96, None)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _coordinates(ents):
    tokens = ents.select("id", F.explode(T.tokens(T.embedding_text(F.col("name"), kg.alias_list("aliases"), F.col("descr")))).alias("token"))
    return vectors.hash_coordinates(tokens, "id", "token")


def entity_vectors(spark, d):
    return vectors.dense(_coordinates(kg.entities(spark, d)), "id")


def structural_edges(spark, d):
    """Distinct sound triples without hub relations, one row per relation."""
    return kg.edges(spark, d).where(~F.col("rel").isin(*HUB_RELATIONS))


def weighted(spark, d, power=2):
    return G.weighted_graph(structural_edges(spark, d).select("src", "dst"), entity_vectors(spark, d), power)


def partition_sizes(spark, d):
    return kg.members(spark, d).groupBy("pid").agg(F.count(F.lit(1)).alias("size"))


_HUBS = ", ".join(f"'{r}'" for r in HUB_RELATIONS)
ENC = f"et AS (SELECT id, unnest({_tok(EMBED)}) AS token FROM ent), ev AS MATERIALIZED {hashed('et', 'id')}"
STR = f"{EDGES}, st AS (SELECT src, dst FROM edg WHERE rel NOT IN ({_HUBS}))"
SIM = f"{STR}, {ENC}, pr AS (SELECT DISTINCT src, dst FROM st), sm AS (SELECT p.src, p.dst, sum(a.val * b.val) AS sim FROM pr p JOIN ev a ON a.id = p.src JOIN ev b ON b.id = p.dst AND b.dim = a.dim GROUP BY ALL), has AS (SELECT DISTINCT id FROM ev), si AS (SELECT st.src, st.dst, CASE WHEN st.src IN (SELECT id FROM has) AND st.dst IN (SELECT id FROM has) THEN coalesce(sm.sim, 0) END AS sim FROM st LEFT JOIN sm ON sm.src = st.src AND sm.dst = st.dst)"
WGT = f"{SIM}, so AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(sim, 9) AS sim FROM si WHERE src <> dst), lo AS (SELECT min(sim) AS m FROM so), wg AS (SELECT u, v, sum(pow(coalesce(sim, m) + CASE WHEN m <= 0 THEN abs(m) + 1e-4 ELSE 0 END, {{p}})) AS w FROM so, lo GROUP BY ALL)"


@query(f"WITH {SIM} SELECT src, dst, count(*) AS n, round(max(sim), 6) AS sim FROM si GROUP BY ALL")
def edge_cosine(spark, d):
    return G.edge_similarity(structural_edges(spark, d).select("src", "dst"), entity_vectors(spark, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("sim"), 6).alias("sim"))


def _weighted_query(power):
    def run(spark, d):
        return weighted(spark, d, power).select("u", "v", F.round("w", 6).alias("w"))

    run.__name__ = f"weighted_graph_p{power}"
    query(f"WITH {WGT.replace("{p}", str(power))} SELECT u, v, round(w, 6) AS w FROM wg")(run)


for _p in (0, 1, 2, 3):
    _weighted_query(_p)

SIZ = f"{MEM}, sz AS (SELECT pid, count(*) AS size FROM mem GROUP BY pid)"


@query(f"WITH {SIZ} SELECT pid, size FROM sz")
def community_sizes(spark, d):
    return partition_sizes(spark, d)


@query(f"WITH {STR}, {MEM} SELECT least(a.pid, b.pid) AS a, greatest(a.pid, b.pid) AS b, count(*) AS n_edges FROM st JOIN mem a ON a.id = st.src JOIN mem b ON b.id = st.dst WHERE a.pid <> b.pid GROUP BY 1, 2")
def community_adjacency(spark, d):
    return G.adjacency(structural_edges(spark, d), kg.members(spark, d))


@query(f"WITH {WGT.replace("{p}", "2")}, {MEM}, e AS (SELECT a.pid AS pu, b.pid AS pv, w FROM wg JOIN mem a ON a.id = u JOIN mem b ON b.id = v), x AS (SELECT pu AS p, w, CASE WHEN pu = pv THEN w ELSE 0 END AS i FROM e UNION ALL SELECT pv, w, 0 FROM e), per AS (SELECT p, sum(w) AS t, sum(i) AS i FROM x GROUP BY p) SELECT round(sum(2 * i / (SELECT sum(t) FROM per) - pow(t / (SELECT sum(t) FROM per), 2)), 6) AS modularity FROM per")
def modularity(spark, d):
    return G.modularity(weighted(spark, d), kg.members(spark, d)).select(F.round("modularity", 6).alias("modularity"))


@query(f"WITH {SIZ} SELECT count(*) AS k, CAST(sum(size) AS BIGINT) AS total, round(avg(size), 6) AS mean, min(size) AS min, round(quantile_cont(size, 0.5), 6) AS median, round(stddev_samp(size), 6) AS stdev, round(quantile_cont(size, 0.9), 6) AS p90, round(quantile_cont(size, 0.95), 6) AS p95, round(quantile_cont(size, 0.99), 6) AS p99, max(size) AS max, round(max(size) / avg(size), 6) AS load, round(count(*) * max(size) / sum(size) - 1, 6) AS imbalance, count(*) FILTER (size > {CAP}) AS n_over FROM sz")
def balance_block(spark, d):
    return G.balance(partition_sizes(spark, d), CAP)


@query(f"WITH {SIZ}, r AS (SELECT size, row_number() OVER (ORDER BY size) AS i FROM sz) SELECT round(2.0::DOUBLE * sum(i * size) / (count(*) * sum(size)) - (count(*) + 1.0::DOUBLE) / count(*), 6) AS gini FROM r")
def gini(spark, d):
    return G.gini(partition_sizes(spark, d)).select(F.round("gini", 6).alias("gini"))


def unassigned(spark, d):
    """Entities without a partition, with vectors: ``id, vec``. Only these are encoded."""
    lone = kg.entities(spark, d).join(kg.members(spark, d), "id", "left_anti")
    return vectors.dense(_coordinates(lone), "id")


_LONE = f"{ENT}, {MEM}, {ENC}, {CEN}, lone AS (SELECT id FROM ent WHERE id NOT IN (SELECT id FROM mem)), sc AS (SELECT e.id, c.id AS pid, round(sum(e.val * c.val), 9) AS sim FROM ev e JOIN lone USING (id) JOIN cen c ON c.dim = e.dim GROUP BY ALL)"


@query(f"WITH {_LONE} SELECT id, pid, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pid) AS r FROM sc) WHERE r = 1")
def nearest_centroid_assign(spark, d):
    near = vectors.products(centroid_vectors(spark, d).withColumnRenamed("id", "qid"), unassigned(spark, d), keep=1, of="row")
    return near.select("id", F.col("qid").alias("pid"), F.round("score", 6).alias("sim"))


@query()
def coarse_assign(spark, d):
    """Entities without a partition to the nearest centroid of their nearest coarse cells; no cap. See ``coarse_assign_recall`` for the loss."""
    near = vectors.coarse_nearest(unassigned(spark, d), centroid_vectors(spark, d), COARSE_CELLS, COARSE_PROBES)
    return near.select("id", "pid", F.round("score", 6).alias("sim"))


@query()
def coarse_assign_recall(spark, d):
    """How often the coarse search finds a centroid as near as the nearest of all."""
    exact = nearest_centroid_assign(spark, d).select("id", F.col("sim").alias("best"))
    both = exact.join(coarse_assign(spark, d), "id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sim") >= F.col("best")).alias("n_hit"), F.round(F.avg(F.col("best") - F.col("sim")), 6).alias("mean_loss"))


@query()
def capped_assign(spark, d):
    """Entities without a partition to the nearest centroid whose partition has room under the cap (``CENTROIDS`` nearest each)."""
    near = vectors.products(centroid_vectors(spark, d).withColumnRenamed("id", "qid"), unassigned(spark, d), keep=CENTROIDS, of="row")
    near = near.select("id", F.col("qid").alias("pid"), F.col("score").alias("sim"))
    room = table(spark, d, "centroids").select(F.col("partition_id").alias("pid")).join(partition_sizes(spark, d), "pid", "left").select("pid", F.greatest(F.lit(0), CAP - F.coalesce("size", F.lit(0))).alias("room"))
    return G.capped_assignment(near, room)


@query()
def graph_communities(spark, d):
    """Communities of the weighted structural graph at resolution 3."""
    return G.communities(weighted(spark, d))




@query(f"WITH RECURSIVE {STR}, bo AS (SELECT src AS u, dst AS v FROM st UNION SELECT dst, src FROM st), re AS (SELECT u AS id, u AS c FROM bo UNION SELECT b.v, r.c FROM re r JOIN bo b ON b.u = r.id WHERE r.c < b.v) SELECT id, min(c) AS component FROM re GROUP BY id")
def graph_components(spark, d):
    e = structural_edges(spark, d)
    return G.components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")), e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())


@query(f"WITH {SIZ} SELECT m.id, m.pid, CAST(CASE WHEN s.size > {CAP} THEN CAST('0x' || substr(md5(m.id), 1, 8) AS BIGINT) % CAST(ceil(s.size / {CAP}.0) AS BIGINT) ELSE 0 END AS INT) AS part FROM mem m JOIN sz s ON s.pid = m.pid")
def split_oversized(spark, d):
    return G.split_oversized(kg.members(spark, d), CAP)


_ADJ = f"{STR}, {SIZ}, ad AS (SELECT least(a.pid, b.pid) AS a, greatest(a.pid, b.pid) AS b, count(*) AS n FROM st JOIN mem a ON a.id = st.src JOIN mem b ON b.id = st.dst WHERE a.pid <> b.pid GROUP BY 1, 2)"


@query(f"WITH {_ADJ}, pr AS (SELECT a AS pid, b AS into_, n FROM ad UNION ALL SELECT b, a, n FROM ad), ft AS (SELECT p.pid, s.size, p.into_, t.size AS held, p.n FROM pr p JOIN sz s ON s.pid = p.pid AND s.size < {LEAST} JOIN sz t ON t.pid = p.into_ AND t.size >= {LEAST} WHERE s.size + t.size <= {CAP}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n DESC, into_) AS r FROM ft) WHERE r = 1), u AS (SELECT *, sum(size) OVER (PARTITION BY into_ ORDER BY size, pid) AS upto FROM o) SELECT pid, into_ AS \"into\" FROM u WHERE upto + held <= {CAP}")
def merge_small(spark, d):
    return G.merge_small(partition_sizes(spark, d), G.adjacency(structural_edges(spark, d), kg.members(spark, d)), LEAST, CAP)


@query(f"WITH {_ADJ}, {CEN}, al AS (SELECT pid, size FROM sz WHERE size < {LEAST} AND pid NOT IN (SELECT a FROM ad UNION SELECT b FROM ad)), kn AS (SELECT a.pid, c.id AS other, round(sum(q.val * c.val), 9) AS sim FROM al a JOIN cen q ON q.id = a.pid JOIN cen c ON c.dim = q.dim AND c.id <> a.pid GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, other) AS r FROM kn) WHERE r <= 10), f AS (SELECT t.pid, t.other, t.sim FROM t JOIN al ON al.pid = t.pid JOIN sz s ON s.pid = t.other WHERE al.size + s.size <= {CAP}) SELECT pid, other AS \"into\" FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, other) AS r FROM f) WHERE r = 1")
def merge_isolated(spark, d):
    adj = G.adjacency(structural_edges(spark, d), kg.members(spark, d))
    return G.merge_isolated(partition_sizes(spark, d), adj, _near_isolated(spark, d), LEAST, CAP)


def _near_isolated(spark, d):
    """``pid, other, sim``: the ten nearest of every small partition without an adjacent one."""
    adj, sizes, cen = G.adjacency(structural_edges(spark, d), kg.members(spark, d)), partition_sizes(spark, d), centroid_vectors(spark, d)
    touched = adj.select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    alone = sizes.where(F.col("size") < LEAST).join(touched, "pid", "left_anti").join(cen.withColumnRenamed("id", "pid"), "pid").select(F.col("pid").alias("qid"), "vec")
    scores = vectors.products(alone, cen, keep=11).where("qid <> id")
    return vectors.best(scores.drop("rank"), 10).select(F.col("qid").cast("int").alias("pid"), F.col("id").cast("int").alias("other"), F.col("score").alias("sim"))


@query()
def merge_small_repeated(spark, d):
    """Small partitions merged with their neighbours in rounds, under rising caps and at last none, until no small one has a neighbour."""
    adj = G.adjacency(structural_edges(spark, d), kg.members(spark, d)).withColumnRenamed("n_edges", "weight")
    return G.merge_rounds(partition_sizes(spark, d), adj, LEAST, CAP_LADDER)


@query()
def merge_isolated_repeated(spark, d):
    """Small partitions without a neighbour merged with the most similar of their ten nearest, in rounds that keep the cap."""
    sizes, near = partition_sizes(spark, d), _near_isolated(spark, d)
    links = near.select(F.col("pid").alias("a"), F.col("other").alias("b"), F.col("sim").alias("weight"))
    return G.merge_rounds(sizes, links, LEAST, (CAP,), movers=near.select("pid").distinct(), strict=True)


@query(f"WITH {CEN}, q AS (SELECT id, dim, val FROM cen WHERE id % 100 = 0), s AS (SELECT q.id, c.id AS other, round(sum(q.val * c.val), 9) AS sim FROM q JOIN cen c ON c.dim = q.dim WHERE q.id <> c.id GROUP BY ALL), p AS (SELECT id, avg(1 - sim) AS m, min(1 - sim) AS nn FROM s GROUP BY id) SELECT count(*) AS n, round(avg(m), 6) AS mean_distance, round(avg(nn), 6) AS nearest_distance FROM p")
def centroid_dispersion(spark, d):
    """Mean and nearest cosine distance of the centroids with an id divisible by 100 to all others."""
    cen = centroid_vectors(spark, d)
    s = vectors.products(cen.where("id % 100 = 0").withColumnRenamed("id", "qid"), cen).where("qid <> id")
    p = s.groupBy("qid").agg(F.avg(1 - F.col("score")).alias("m"), F.min(1 - F.col("score")).alias("nn"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("mean_distance"), F.round(F.avg("nn"), 6).alias("nearest_distance"))


def premise_ends(spark, d):
    """``item_id, pos, src, dst, ps, pt``: premises with the partitions of their ends."""
    p = table(spark, d, "test_items").select("item_id", F.posexplode(T.premises(F.col("grounding"))).alias("pos", "p")).select("item_id", "pos", F.split("p", r"\|").alias("x"))
    m = kg.members(spark, d)
    return p.select("item_id", "pos", F.col("x")[0].alias("src"), F.col("x")[2].alias("dst")).join(m.select(F.col("id").alias("src"), F.col("pid").alias("ps")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("pid").alias("pt")), "dst", "left")


@query(f"WITH {MEM}, p AS (SELECT item_id, pos, string_split(premise, '|')[1] AS src, string_split(premise, '|')[3] AS dst FROM ({PREMISES})), e AS (SELECT p.*, a.pid AS ps, b.pid AS pt FROM p LEFT JOIN mem a ON a.id = p.src LEFT JOIN mem b ON b.id = p.dst), q AS (SELECT item_id, bool_and(coalesce(ps = pt, false)) AS all_in, bool_or(pos = 1 AND coalesce(ps = pt, false)) AS hop1, count(*) FILTER (coalesce(ps <> pt, true)) AS crossings, count(*) AS n FROM e GROUP BY item_id) SELECT count(*) AS n_paths, round(avg(all_in::INT), 6) AS containment, round(avg(hop1::INT), 6) AS hop_1, round(avg(crossings), 6) AS crossings, round(1 - sum(crossings)::DOUBLE / sum(n), 6) AS co_partition FROM q")
def path_containment(spark, d):
    same = F.coalesce(F.col("ps") == F.col("pt"), F.lit(False))
    q = premise_ends(spark, d).groupBy("item_id").agg(F.every(same).alias("all_in"), F.some(same & (F.col("pos") == 0)).alias("hop1"), F.count_if(~same).alias("crossings"), F.count(F.lit(1)).alias("n"))
    return q.agg(F.count(F.lit(1)).alias("n_paths"), F.round(F.avg(F.col("all_in").cast("int")), 6).alias("containment"), F.round(F.avg(F.col("hop1").cast("int")), 6).alias("hop_1"), F.round(F.avg("crossings"), 6).alias("crossings"), F.round(1 - F.sum("crossings") / F.sum("n"), 6).alias("co_partition"))
