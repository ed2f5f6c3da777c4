"""Queries of the evaluation metrics, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import kg, metrics
from knotwork.plans.sqlparts import EDGES, ENT, MEM
from knotwork.plans.text import _LIT, PREMISES, _in, _tok
from knotwork.sources import table

QUERIES, SQL = {}, {}
RESAMPLES = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NORM = lambda c: f"list_filter({_tok(c)}, lambda t: t NOT IN {_in(T.ARTICLES)})"
F1 = f"""pg AS (SELECT item_id AS key, {_NORM('passage')} AS pred, {_NORM('question')} AS gold FROM test_items WHERE passage IS NOT NULL AND question IS NOT NULL),
pp AS (SELECT key, t, count(*) AS n FROM (SELECT key, unnest(pred) AS t FROM pg) GROUP BY ALL), gg AS (SELECT key, t, count(*) AS n FROM (SELECT key, unnest(gold) AS t FROM pg) GROUP BY ALL),
cc AS (SELECT pp.key, sum(least(pp.n, gg.n)) AS c FROM pp JOIN gg ON gg.key = pp.key AND gg.t = pp.t GROUP BY 1),
sc AS (SELECT pg.key, CAST(pred = gold AS INT) AS em, CASE WHEN len(pred) + len(gold) = 0 THEN 1 ELSE 2 * coalesce(c, 0)::DOUBLE / (len(pred) + len(gold)) END AS f1 FROM pg LEFT JOIN cc ON cc.key = pg.key)"""


def scored_items(spark, d):
    """Passages scored as answers against their questions."""
    words = lambda c: F.filter(T.tokens(F.col(c)), lambda t: ~t.isin(*T.ARTICLES))
    t = table(spark, d, "test_items").where("passage is not null and question is not null")
    return metrics.token_f1(t.select(F.col("item_id").alias("key"), words("passage").alias("pred"), words("question").alias("gold")))


@query(f"WITH {F1} SELECT key, em, round(f1, 6) AS f1 FROM sc")
def answer_em_f1(spark, d):
    return scored_items(spark, d).select("key", "em", F.round("f1", 6).alias("f1"))


SETS = f"se AS (SELECT item_id, rule_index, list_distinct(list_concat({_LIT.format(c='q_entity')}, regexp_extract_all(grounding, '\\bQ[0-9]+\\b'))) AS pred, {_LIT.format(c='answer')} AS gold FROM test_items), ss AS (SELECT *, len(list_intersect(pred, gold)) AS k FROM se)"


def answer_sets(spark, d):
    t = table(spark, d, "test_items")
    return t.select("item_id", "rule_index", F.array_union(T.literal_list(F.col("q_entity")), T.entity_ids(F.col("grounding"))).alias("pred"), T.literal_list(F.col("answer")).alias("gold"))


@query(f"WITH {SETS} SELECT item_id, round(k::DOUBLE / nullif(len(pred), 0), 6) AS precision, round(k::DOUBLE / nullif(len(list_distinct(gold)), 0), 6) AS recall, round(2.0::DOUBLE * k / nullif(len(pred) + len(list_distinct(gold)), 0), 6) AS f1, k > 0 AS hit_any, coalesce(list_contains(pred, gold[1]), false) AS hit_hard FROM ss")
def set_prf(spark, d):
    a = answer_sets(spark, d)
    s = metrics.set_scores(F.col("pred"), F.col("gold"))
    return a.select("item_id", *[F.round(c, 6).alias(n) for n, c in s.items()], F.arrays_overlap("pred", "gold").alias("hit_any"), F.coalesce(F.array_contains("pred", F.get("gold", F.lit(0))), F.lit(False)).alias("hit_hard"))


@query(f"WITH {SETS} SELECT count(*) AS n, round(avg((k > 0)::INT), 6) AS hits_any, round(avg(coalesce(list_contains(pred, gold[1]), false)::INT), 6) AS hits_hard, round(coalesce(sum(coalesce(list_contains(pred, gold[1]), false)::INT)::DOUBLE / nullif(sum((k > 0)::INT), 0), 0), 6) AS hhr FROM ss")
def hard_hit_ratio(spark, d):
    s = set_prf(spark, d)
    any_, hard = F.col("hit_any").cast("int"), F.col("hit_hard").cast("int")
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(any_), 6).alias("hits_any"), F.round(F.avg(hard), 6).alias("hits_hard"), F.round(F.coalesce(F.try_divide(F.sum(hard), F.sum(any_)), F.lit(0.0)), 6).alias("hhr"))


COVER = f"{EDGES}, pm AS (SELECT item_id, rule_index, premise FROM ({PREMISES})), cv AS (SELECT p.item_id, p.rule_index, count(*) AS n, count(e.k) AS found FROM pm p LEFT JOIN (SELECT src || '|' || rel || '|' || dst AS k FROM edg) e ON e.k = p.premise GROUP BY ALL)"


def covered(spark, d):
    """``item_id, rule_index, n, found``: premises of each item and how many are sound triples."""
    p = table(spark, d, "test_items").select("item_id", "rule_index", F.explode(T.premises(F.col("grounding"))).alias("premise"))
    known = kg.edges(spark, d).select(F.concat_ws("|", "src", "rel", "dst").alias("premise"), F.lit(1).alias("hit"))
    return p.join(known, "premise", "left").groupBy("item_id", "rule_index").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"))


@query(f"WITH {COVER} SELECT item_id, n, found, round(found::DOUBLE / n, 6) AS recall, found = n AS complete FROM cv")
def path_coverage(spark, d):
    return covered(spark, d).select("item_id", "n", "found", F.round(F.col("found") / F.col("n"), 6).alias("recall"), (F.col("found") == F.col("n")).alias("complete"))


@query()
def citation_support(spark, d):
    """Cited labels of each document whose number is that of a relation."""
    c = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(T.citation_labels(F.col("text"))).alias("label"))
    rels = kg.relations(spark, d).select("rel", F.lit(1).alias("hit"))
    j = c.withColumn("rel", F.split_part("label", F.lit("."), F.lit(1))).join(rels, "rel", "left")
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_cited"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("precision"))


SQL["citation_support"] = r"WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\[(P[0-9]+\.E[0-9]+|S[0-9]+)\]', 1))) AS label FROM documents WHERE text IS NOT NULL), r AS (SELECT DISTINCT upper(trim(relation_id)) AS rel FROM relations) SELECT doc_id, count(*) AS n_cited, round(count(r.rel)::DOUBLE / count(*), 6) AS precision FROM c LEFT JOIN r ON r.rel = split_part(c.label, '.', 1) GROUP BY doc_id"


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return metrics.summary(table(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, round(v[len(v) // 2 + 1], 6) AS median, round(v[CAST(floor(len(v) * 0.95::DOUBLE) AS BIGINT) + 1], 6) AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def latency_by_index(spark, d):
    q = metrics.index_quantiles(table(spark, d, "events"), "event_type", "value")
    return q.select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


def metric_rows(spark, d):
    """``item_id, rule_index, a, b``: recall of the answers among the named ids, and of the premises in the graph."""
    s = answer_sets(spark, d).select("item_id", "rule_index", F.coalesce(metrics.set_scores(F.col("pred"), F.col("gold"))["recall"], F.lit(0.0)).alias("a"))
    return s.join(covered(spark, d).select("item_id", (F.col("found") / F.col("n")).alias("b")), "item_id", "left").withColumn("b", F.coalesce("b", F.lit(0.0)))


ROWS = f"{COVER}, {SETS}, mr AS (SELECT s.item_id, s.rule_index, coalesce(k::DOUBLE / nullif(len(list_distinct(gold)), 0), 0) AS a, coalesce(found::DOUBLE / n, 0) AS b FROM ss s LEFT JOIN cv ON cv.item_id = s.item_id)"
_ENDS = " ".join(f"WHEN u < {end}::DOUBLE THEN {n}" for n, end in enumerate(metrics._POISSON))
#: Poisson(1) draws of the items ``it`` (key, s, c) and the interval over all resamples.
_BOOT = f"""dr AS (SELECT r, s, c, CAST('0x' || substr(md5(r || ':' || key), 1, 12) AS BIGINT) / {float(1 << 48)}::DOUBLE AS u FROM it, (SELECT unnest(range({RESAMPLES})) AS r) q),
m AS (SELECT sum(w * s) / nullif(sum(w * c), 0) AS m FROM (SELECT r, s, c, CASE {_ENDS} ELSE {len(metrics._POISSON)} END AS w FROM dr) GROUP BY r)
SELECT round((SELECT sum(s) / sum(c) FROM it), 6) AS {{name}}, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""


@query(f"WITH {ROWS}, it AS (SELECT CAST(item_id AS VARCHAR) AS key, a - b AS s, 1 AS c FROM mr), {_BOOT.format(name='difference')}")
def paired_bootstrap(spark, d):
    return metrics.paired_bootstrap(metric_rows(spark, d).select(F.col("item_id").alias("key"), "a", "b"), RESAMPLES)


@query(f"WITH {ROWS}, it AS (SELECT coalesce(rule_index, '') AS key, sum(b) AS s, count(b) AS c FROM mr GROUP BY rule_index), {_BOOT.format(name='mean')}")
def cluster_bootstrap(spark, d):
    return metrics.cluster_bootstrap(metric_rows(spark, d).select(F.col("rule_index").alias("cluster"), F.col("b").alias("value")), RESAMPLES)


@query(f"WITH {ROWS} SELECT 'answer_recall' AS metric, round(avg(a), 6) AS mean, count(a) AS n FROM mr UNION ALL SELECT 'premise_recall', round(avg(b), 6), count(b) FROM mr")
def macro_aggregate(spark, d):
    rows = metric_rows(spark, d).select(F.explode(F.array(F.struct(F.lit("answer_recall").alias("metric"), F.col("a").alias("v")), F.struct(F.lit("premise_recall").alias("metric"), F.col("b").alias("v")))).alias("x"))
    return rows.groupBy("x.metric").agg(F.round(F.avg("x.v"), 6).alias("mean"), F.count("x.v").alias("n"))


@query("SELECT rule_index, count(*) AS n, min(item_id) AS first_item FROM test_items GROUP BY rule_index")
def stratified_sample(spark, d):
    """The first item of every rule, with the rule's size."""
    return table(spark, d, "test_items").groupBy("rule_index").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"))


@query(f"WITH {ENT} SELECT a.item_id, a.id AS answer_id, e.name AS answer_name FROM (SELECT item_id, unnest({_LIT.format(c='answer')}) AS id FROM test_items) a LEFT JOIN ent e ON e.id = a.id AND e.name <> ''")
def gold_labels(spark, d):
    a = table(spark, d, "test_items").select("item_id", F.explode(T.literal_list(F.col("answer"))).alias("answer_id"))
    names = kg.entities(spark, d).where("name <> ''").select(F.col("id").alias("answer_id"), F.col("name").alias("answer_name"))
    return a.join(names, "answer_id", "left").select("item_id", "answer_id", "answer_name")


@query(f"WITH {ENT}, {MEM}, g AS (SELECT DISTINCT a.item_id, m.pid FROM (SELECT item_id, unnest({_LIT.format(c='answer')}) AS id FROM test_items) a JOIN mem m ON m.id = a.id) SELECT item_id, count(*) AS n_partitions, min(pid) AS first_pid FROM g GROUP BY item_id")
def gold_partition_map(spark, d):
    a = table(spark, d, "test_items").select("item_id", F.explode(T.literal_list(F.col("answer"))).alias("id"))
    return a.join(kg.members(spark, d), "id").select("item_id", "pid").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("n_partitions"), F.min("pid").alias("first_pid"))


@query(f"WITH {ENT}, q AS (SELECT item_id, unnest(regexp_extract_all(grounding, '\\bQ[0-9]+\\b')) AS id FROM test_items) SELECT count(*) AS returned, count(*) FILTER (id IN (SELECT id FROM ent)) AS grounded, round(100.0 * count(*) FILTER (id IN (SELECT id FROM ent)) / count(*), 6) AS grounded_pct FROM q")
def grounding_audit(spark, d):
    q = table(spark, d, "test_items").select(F.explode(T.entity_ids(F.col("grounding"))).alias("id"))
    known = kg.deliveries(spark, d).select("id").distinct().withColumn("hit", F.lit(1))
    return q.join(known, "id", "left").agg(F.count(F.lit(1)).alias("returned"), F.count("hit").alias("grounded"), F.round(100.0 * F.count("hit") / F.count(F.lit(1)), 6).alias("grounded_pct"))
