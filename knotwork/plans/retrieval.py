"""Queries of index building, routing and ranking, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import kg, retrieval, vectors
from knotwork.plans.sqlparts import ENT, MEM
from knotwork.plans.text import _LIT, MENTIONS, _tok
from knotwork.sources import table

QUERIES, SQL = {}, {}
TOP = 10
WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The index: a partition's document is the names and descriptions of its members.
def partition_tokens(spark, d):
    doc = kg.members(spark, d).join(kg.entities(spark, d), "id")
    return doc.select(F.col("pid").alias("id"), F.explode(T.tokens(F.concat_ws(" ", "name", "descr"))).alias("token"))


def question_terms(spark, d):
    return table(spark, d, "test_items").where("question is not null").select(F.col("item_id").alias("qid"), F.explode(T.tokens(F.col("question"))).alias("token"))


def question_vectors(spark, d):
    return vectors.dense(vectors.hash_coordinates(question_terms(spark, d), "qid", "token"), "qid")


def centroid_vectors(spark, d):
    return table(spark, d, "centroids").where("centroid is not null").select(F.col("partition_id").alias("id"), vectors.unit(F.col("centroid")).alias("vec")).where("vec is not null")


def dense_scores(spark, d, keep=None):
    return vectors.products(question_vectors(spark, d), centroid_vectors(spark, d), keep=keep)


def lexical_scores(spark, d):
    return retrieval.bm25(retrieval.Postings(partition_tokens(spark, d), keep=True), question_terms(spark, d))


def fused_pairs(spark, d):
    return retrieval.both_scores(dense_scores(spark, d), lexical_scores(spark, d))


def gold_partitions(spark, d):
    """``qid, id``: partitions of the answers."""
    answers = table(spark, d, "test_items").select(F.col("item_id").alias("qid"), F.explode(T.literal_list(F.col("answer"))).alias("eid"))
    return answers.join(kg.members(spark, d).withColumnRenamed("id", "eid"), "eid").select("qid", F.col("pid").alias("id")).distinct()


POST = f"""{ENT}, {MEM}, occ AS (SELECT m.pid AS id, unnest({_tok("e.name || ' ' || e.descr")}) AS token FROM mem m JOIN ent e ON e.id = m.id),
tf AS (SELECT id, token, count(*) AS tf FROM occ GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
qt AS (SELECT DISTINCT item_id AS qid, token FROM (SELECT item_id, unnest({_tok('question')}) AS token FROM test_items WHERE question IS NOT NULL)),
bm AS (SELECT qt.qid, tf.id, round(sum(ln(1 + ((SELECT count(*) FROM dl) - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / (SELECT avg(dl) FROM dl)))), 9) AS score
  FROM qt JOIN df ON df.token = qt.token JOIN tf ON tf.token = qt.token JOIN dl ON dl.id = tf.id GROUP BY ALL)"""


def hashed(rel: str, key: str) -> str:
    """Coordinates of ``rel`` (key, token): the SQL twin of the hashed encoding."""
    return f"""(SELECT {key}, dim, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS val FROM (SELECT {key}, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS dim, sum(CASE WHEN substr(md5(token), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM {rel} GROUP BY 1, 2) WHERE v <> 0)"""


QALL = f"qa AS (SELECT item_id AS qid, unnest({_tok('question')}) AS token FROM test_items WHERE question IS NOT NULL)"
CEN = "cen AS (SELECT id, dim, x / nrm AS val FROM (SELECT partition_id AS id, generate_subscripts(centroid, 1) - 1 AS dim, unnest(centroid)::DOUBLE AS x, sqrt(list_sum(list_transform(centroid, lambda y: y::DOUBLE * y::DOUBLE))) AS nrm FROM centroids WHERE centroid IS NOT NULL) WHERE nrm > 0)"
DEN = f"{QALL}, qv AS {hashed('qa', 'qid')}, {CEN}, den AS (SELECT q.qid, c.id, round(sum(q.val * c.val), 9) AS score FROM qv q JOIN cen c ON c.dim = q.dim GROUP BY ALL)"
BOTH = f"{POST}, {DEN}, bo AS (SELECT d.qid, d.id, d.score AS d, coalesce(b.score, 0) AS b FROM den d LEFT JOIN bm b ON b.qid = d.qid AND b.id = d.id)"
NRM = f"{BOTH}, nr AS (SELECT qid, id, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-10) AS dn, (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w + 1e-10) AS bn FROM bo WINDOW w AS (PARTITION BY qid))"
GOLD = f"gold AS (SELECT DISTINCT a.qid, m.pid AS id FROM (SELECT item_id AS qid, unnest({_LIT.format(c='answer')}) AS eid FROM test_items) a JOIN mem m ON m.id = a.eid)"


def _top(rel: str, k: int = TOP) -> str:
    return f"SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {rel}) WHERE rank <= {k}"


def _ranked(scores, k: int = TOP):
    top = vectors.best(scores, k)
    return top.select(F.col("qid").cast("bigint").alias("qid"), F.col("id").cast("bigint").alias("id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {POST} SELECT token, df FROM df")
def bm25_df(spark, d):
    return retrieval.Postings(partition_tokens(spark, d)).df


@query(f"WITH {POST} SELECT id, CAST(dl AS BIGINT) AS dl FROM dl")
def bm25_lengths(spark, d):
    return retrieval.Postings(partition_tokens(spark, d)).lengths


@query(f"WITH {POST} {_top('bm')}")
def bm25_topk(spark, d):
    return _ranked(lexical_scores(spark, d))


@query(f"""WITH occ AS (SELECT doc_id AS id, unnest({_tok('text')}) AS token FROM documents WHERE text IS NOT NULL), tf AS (SELECT id, token, count(*) AS tf FROM occ GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
qt AS (SELECT DISTINCT item_id AS qid, token FROM (SELECT item_id, unnest({_tok('question')}) AS token FROM test_items WHERE question IS NOT NULL)),
bm AS (SELECT qt.qid, tf.id, round(sum(ln(1 + ((SELECT count(*) FROM dl) - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / (SELECT avg(dl) FROM dl)))), 9) AS score
  FROM qt JOIN df ON df.token = qt.token JOIN tf ON tf.token = qt.token JOIN dl ON dl.id = tf.id GROUP BY ALL) {_top('bm')}""")
def bm25_documents(spark, d):
    tokens = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.explode(T.tokens(F.col("text"))).alias("token"))
    return _ranked(retrieval.bm25(retrieval.Postings(tokens, keep=True), question_terms(spark, d)))


@query("SELECT label, generate_subscripts(m, 1) - 1 AS dim, round(unnest(m), 6) AS mean FROM (SELECT label, list(mean ORDER BY dim) AS m FROM (SELECT label, dim, avg(x) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY label)")
def centroid_means(spark, d):
    m = vectors.mean_coordinates(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT label, dim, avg(x) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL), u AS (SELECT label, dim, mean / (sqrt(sum(mean * mean) OVER (PARTITION BY label)) + 1e-10) AS u FROM m),
s AS (SELECT e.vec_id, u.label, round(sum(e.x * u.u), 9) AS score FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) e JOIN u ON u.dim = e.dim GROUP BY ALL)
SELECT vec_id, label AS nearest, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""")
def nearest_label(spark, d):
    """Each embedding with the label whose normalised mean is nearest."""
    e = table(spark, d, "embeddings")
    m = vectors.mean_coordinates(e, "label", "embedding").withColumn("val", F.col("mean") / (F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy("label"))) + 1e-10))
    means = vectors.dense(m.select(F.col("label").alias("id"), "dim", "val"), "id")
    near = vectors.products(means.withColumnRenamed("id", "qid"), e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")), keep=1, of="row")
    return near.select(F.col("id").alias("vec_id"), F.col("qid").cast("int").alias("nearest"), F.round("score", 6).alias("score"))


@query(f"WITH {QALL}, qv AS {hashed('qa', 'qid')} SELECT qid, dim, round(val, 6) AS val FROM qv")
def question_encoding(spark, d):
    c = vectors.hash_coordinates(question_terms(spark, d), "qid", "token")
    return c.select("qid", F.col("dim").cast("bigint").alias("dim"), F.round("val", 6).alias("val"))


@query(f"WITH {DEN} {_top('den')}")
def dense_topk(spark, d):
    return _ranked(dense_scores(spark, d, keep=TOP))


@query(f"WITH {NRM}, f AS (SELECT qid, id, round(0.5::DOUBLE * dn + 0.5::DOUBLE * bn, 9) AS score FROM nr) {_top('f')}")
def hybrid_topk(spark, d):
    return _ranked(retrieval.fuse(fused_pairs(spark, d)))


@query(f"WITH {BOTH}, rk AS (SELECT qid, id, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY d DESC, id)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY b DESC, id)), 9) AS score FROM bo) {_top('rk')}")
def rrf_topk(spark, d):
    return _ranked(retrieval.reciprocal_rank_fusion(fused_pairs(spark, d)))


_SWEEP = f"""{NRM}, {GOLD}, ev AS (SELECT w.weight, qid, id, round(w.weight * dn + (1 - w.weight) * bn, 9) AS score FROM nr, (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS weight) w),
tp AS (SELECT weight, qid, id FROM (SELECT *, row_number() OVER (PARTITION BY weight, qid ORDER BY score DESC, id) AS r FROM ev) WHERE r <= 5), hi AS (SELECT t.weight, t.qid, max(CASE WHEN g.id IS NULL THEN 0 ELSE 1 END) AS hit FROM tp t LEFT JOIN gold g ON g.qid = t.qid AND g.id = t.id GROUP BY ALL)"""


@query(f"WITH {_SWEEP} SELECT weight, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n FROM hi GROUP BY weight")
def weight_sweep(spark, d):
    return retrieval.sweep(fused_pairs(spark, d), gold_partitions(spark, d), WEIGHTS)


@query(f"WITH {_SWEEP} SELECT weight, hits FROM (SELECT weight, CAST(sum(hit) AS BIGINT) AS hits FROM hi GROUP BY weight) ORDER BY hits DESC, weight LIMIT 1")
def weight_sweep_best(spark, d):
    return retrieval.sweep(fused_pairs(spark, d), gold_partitions(spark, d), WEIGHTS).select("weight", "hits").orderBy(F.desc("hits"), "weight").limit(1)


_HYB = f"{NRM}, {GOLD}, f AS (SELECT qid, id, round(0.5::DOUBLE * dn + 0.5::DOUBLE * bn, 9) AS score FROM nr), rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)"


@query(f"""WITH {_HYB}, per AS (SELECT g.qid, min(r.rank) AS first, count(*) AS n_gold, count(*) FILTER (r.rank <= 1) AS f1, count(*) FILTER (r.rank <= 3) AS f3, count(*) FILTER (r.rank <= 5) AS f5 FROM gold g LEFT JOIN rk r ON r.qid = g.qid AND r.id = g.id GROUP BY g.qid)
SELECT qid, coalesce(first, 0) AS first_hit, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, n_gold, CAST(f1 > 0 AS INT) AS hit_1, CAST(f3 > 0 AS INT) AS hit_3, CAST(f5 > 0 AS INT) AS hit_5, round(f1::DOUBLE / n_gold, 6) AS recall_1, round(f3::DOUBLE / n_gold, 6) AS recall_3, round(f5::DOUBLE / n_gold, 6) AS recall_5 FROM per""")
def hybrid_metrics(spark, d):
    fused = retrieval.fuse(fused_pairs(spark, d))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return retrieval.ranking_metrics(ranked, gold_partitions(spark, d))


@query(f"WITH {_HYB} SELECT round(avg(CASE WHEN first IS NULL OR first > 100 THEN 0 ELSE 1.0::DOUBLE / first END), 6) AS mrr_100, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hits_5, count(*) AS n FROM (SELECT g.qid, min(r.rank) AS first FROM gold g LEFT JOIN rk r ON r.qid = g.qid AND r.id = g.id GROUP BY g.qid)")
def hybrid_summary(spark, d):
    fused = retrieval.fuse(fused_pairs(spark, d))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    m = retrieval.ranking_metrics(ranked, gold_partitions(spark, d))
    rr = F.when((F.col("first_hit") == 0) | (F.col("first_hit") > 100), 0.0).otherwise(1 / F.col("first_hit"))
    return m.agg(F.round(F.avg(rr), 6).alias("mrr_100"), F.round(F.avg(F.col("hit_5").cast("double")), 6).alias("hits_5"), F.count(F.lit(1)).alias("n"))


_SIZE = "sz AS (SELECT pid AS id, count(*) AS size FROM mem GROUP BY pid)"


@query(f"WITH {DEN}, {MEM}, {_SIZE}, t AS ({_top('den', 3)}), v AS (SELECT t.qid, sum(coalesce(s.size, 0)) AS volume FROM t LEFT JOIN sz s ON s.id = t.id GROUP BY t.qid) SELECT round(avg(volume), 6) AS mean_volume, round(100 * (1 - avg(volume) / (SELECT sum(size) FROM sz)), 6) AS reduction_pct FROM v")
def candidate_reduction(spark, d):
    sizes = kg.members(spark, d).groupBy(F.col("pid").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    v = dense_scores(spark, d, keep=3).join(sizes, "id", "left").groupBy("qid").agg(F.sum(F.coalesce("size", F.lit(0))).alias("volume"))
    return v.agg(F.round(F.avg("volume"), 6).alias("mean_volume"), F.round(100 * (1 - F.avg("volume") / sizes.agg(F.sum("size")).scalar()), 6).alias("reduction_pct"))


@query(f"WITH {DEN}, {MEM}, {_SIZE}, t AS ({_top('den', 5)}) SELECT t.qid, t.id, t.rank, t.score, coalesce(s.size, 0) AS size, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT m.id FROM mem m WHERE m.pid = t.id ORDER BY m.id LIMIT 5)) AS seeds FROM t LEFT JOIN sz s ON s.id = t.id")
def partition_hits(spark, d):
    """The five best partitions of each question with their size and first five members."""
    mem = kg.members(spark, d)
    sizes = mem.groupBy(F.col("pid").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    first = mem.withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy("id"))).where("nth <= 5").groupBy(F.col("pid").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("seeds"))
    hits = dense_scores(spark, d, keep=5).join(sizes, "id", "left").join(first, "id", "left")
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"), F.coalesce("size", F.lit(0)).alias("size"), "seeds")


@query(f"WITH {MEM}, {_SIZE} SELECT (SELECT count(*) FROM centroids) AS n_centroids, (SELECT count(DISTINCT partition_id) FROM centroids) AS n_ids, (SELECT count(*) FROM centroids WHERE centroid IS NULL OR list_sum(list_transform(centroid, lambda x: x::DOUBLE * x::DOUBLE)) = 0) AS n_unusable, (SELECT count(*) FROM sz) AS n_mapped, (SELECT count(*) FROM sz WHERE id NOT IN (SELECT partition_id FROM centroids)) AS n_without_centroid, (SELECT count(*) FROM centroids c LEFT JOIN sz s ON s.id = c.partition_id WHERE c.n_members IS NOT NULL AND c.n_members <> coalesce(s.size, 0)) AS n_size_mismatch")
def index_audit(spark, d):
    c = table(spark, d, "centroids")
    sizes = kg.members(spark, d).groupBy(F.col("pid").alias("partition_id")).agg(F.count(F.lit(1)).alias("size"))
    both = c.withColumn("c", F.lit(True)).join(sizes, "partition_id", "full_outer")
    return both.agg(
        F.count("c").alias("n_centroids"), F.count_distinct(F.when(F.col("c"), F.col("partition_id"))).alias("n_ids"), F.count_if(F.col("c") & vectors.unit(F.col("centroid")).isNull()).alias("n_unusable"),
        F.count("size").alias("n_mapped"), F.count_if(F.col("c").isNull()).alias("n_without_centroid"), F.count_if(F.col("c") & (F.col("n_members") != F.coalesce("size", F.lit(0)))).alias("n_size_mismatch"),
    )


LINK = f"{ENT}, {MENTIONS}, lex AS (SELECT DISTINCT id, lower(name) AS term FROM ent WHERE name <> ''), lk AS (SELECT me.item_id, l.id, min(least(0.3::DOUBLE, 0.1::DOUBLE * len(string_split(me.m, ' ')))) AS lo, max(least(0.3::DOUBLE, 0.1::DOUBLE * len(string_split(me.m, ' ')))) AS score FROM men me JOIN lex l ON l.term = me.m GROUP BY ALL)"


@query(f"WITH {LINK} SELECT item_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM lk) WHERE rank <= 5")
def lexical_linker(spark, d):
    """Entities whose name is mentioned in a question, longer mentions first."""
    asked = table(spark, d, "test_items").where("question is not null").select("item_id", F.explode(T.mentions(F.col("question"))).alias("term"))
    lexicon = kg.entities(spark, d).where("name <> ''").select("id", F.lower("name").alias("term"))
    score = F.least(F.lit(0.3), 0.1 * F.size(F.split("term", " ")))
    linked = asked.join(lexicon, "term").groupBy("item_id", "id").agg(F.max(score).alias("score"))
    top = linked.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "id"))).where("rank <= 5")
    return top.select("item_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {LINK} SELECT t.item_id, t.question || coalesce(' ' || e.name || ' ' || replace(e.aliases, '|', ' '), '') AS expanded FROM test_items t LEFT JOIN (SELECT item_id, id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM lk) WHERE rank = 1) k ON k.item_id = t.item_id LEFT JOIN ent e ON e.id = k.id WHERE t.question IS NOT NULL")
def query_expansion(spark, d):
    top = lexical_linker(spark, d).where("rank = 1").select("item_id", "id")
    named = top.join(kg.entities(spark, d), "id").select("item_id", F.concat(F.lit(" "), F.col("name"), F.lit(" "), F.replace("aliases", F.lit("|"), F.lit(" "))).alias("more"))
    return table(spark, d, "test_items").where("question is not null").join(named, "item_id", "left").select("item_id", F.concat("question", F.coalesce("more", F.lit(""))).alias("expanded"))
