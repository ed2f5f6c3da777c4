"""The verdict on a whole graph: every rule that fails it and every rule that warns, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions.ids import clean_id
from knotwork.operators import audit, kg
from knotwork.plans.audit import _any
from knotwork.plans.sqlparts import EDGES, cid, norm
from knotwork.sources import table

#: Rules in the order of the report: name, level, SQL of the number of rows that break it.
_E, _R = audit.ENTITY_ID, audit.RELATION_ID
RULES = (
    ("entity_duplicate_ids", "fail", "SELECT count(*) - count(DISTINCT id) FROM dlv"),
    ("entity_blank_ids", "fail", f"SELECT count(*) FROM entities WHERE {cid('entity_id')} IS NULL"),
    ("entity_malformed_ids", "fail", f"SELECT count(*) FROM dlv WHERE NOT regexp_matches(id, '{_E}')"),
    ("entity_blank_names", "fail", "SELECT count(*) FROM ent WHERE name = ''"),
    ("relation_duplicate_ids", "fail", "SELECT count(rel) - count(DISTINCT rel) FROM rl"),
    ("relation_blank_ids", "fail", "SELECT count(*) FROM rl WHERE rel IS NULL"),
    ("relation_malformed_ids", "fail", f"SELECT count(*) FROM rl WHERE NOT regexp_matches(rel, '{_R}')"),
    ("relation_blank_names", "fail", "SELECT count(*) FROM rl WHERE rel_name = ''"),
    ("triple_duplicates", "fail", "SELECT count(*) - count(DISTINCT (src, rel, dst)) FROM whl"),
    ("triple_self_loops", "fail", "SELECT count(*) FROM whl WHERE src = dst"),
    ("triple_malformed", "fail", "SELECT (SELECT count(*) FROM tri) - (SELECT count(*) FROM whl)"),
    ("triple_invalid_entity_ids", "fail", f"SELECT coalesce(sum((NOT regexp_matches(src, '{_E}'))::INT + (NOT regexp_matches(dst, '{_E}'))::INT), 0) FROM whl"),
    ("triple_invalid_relation_ids", "fail", f"SELECT count(*) FROM whl WHERE NOT regexp_matches(rel, '{_R}')"),
    ("triple_missing_entities", "fail", "SELECT count(*) FROM whl WHERE src NOT IN (SELECT id FROM ent) OR dst NOT IN (SELECT id FROM ent)"),
    ("triple_missing_relations", "fail", "SELECT count(*) FROM whl WHERE rel NOT IN (SELECT rel FROM rl WHERE rel IS NOT NULL)"),
    ("entity_empty_descriptions", "warn", "SELECT count(*) FROM ent WHERE descr = ''"),
    ("entity_duplicate_names", "warn", f"SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM ent WHERE name <> '' GROUP BY {norm('name')} HAVING count(*) > 1)"),
    ("entity_navigation_descriptions", "warn", f"SELECT count(*) FROM ent WHERE {_any(norm('descr'), audit.NAVIGATION_PHRASES)}"),
    ("entity_wiki_descriptions", "warn", f"SELECT count(*) FROM ent WHERE {_any(norm('descr'), audit.WIKI_MARKS)}"),
    ("entity_repetitive_descriptions", "warn", f"SELECT count(*) FROM (SELECT list_filter(string_split({norm('descr')}, ' '), lambda x: x <> '') AS w FROM ent) WHERE len(w) >= 8 AND len(list_distinct(w)) < CAST(0.45 AS DOUBLE) * len(w)"),
    ("entity_malformed_aliases", "warn", "SELECT count(*) FROM ent WHERE aliases <> '' AND len(list_filter(string_split(aliases, '|'), lambda a: trim(a) = '')) > 0"),
    ("relation_duplicate_names", "warn", "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM rl WHERE rel_name <> '' GROUP BY rel_name HAVING count(*) > 1)"),
    ("relation_unused", "warn", "SELECT count(*) FROM rl WHERE rel NOT IN (SELECT rel FROM edg)"),
    ("entity_isolated", "warn", "SELECT count(*) FROM ent WHERE id NOT IN (SELECT src FROM edg UNION SELECT dst FROM edg)"),
)
LEVELS = {name: level for name, level, _ in RULES}


def broken(spark, d):
    """One row: the number of rows that break each rule, one column a rule. Every table is read for a few aggregates at once."""
    ents, rels, tri = kg.entities(spark, d), kg.relations(spark, d), kg.triples(spark, d)
    ids = table(spark, d, "entities").select(clean_id("entity_id").alias("id"))
    known, edges = kg.deliveries(spark, d).select("id").distinct(), kg.edges(spark, d)
    count = lambda c: F.count_if(c)
    descr = kg.normal(F.col("descr"))
    blank_part = F.exists(F.split("aliases", r"\|"), lambda a: F.trim(a) == "")
    whole = F.col("src").isNotNull() & F.col("rel").isNotNull() & F.col("dst").isNotNull()
    flagged = audit.presence(tri, kg.deliveries(spark, d), rels.where("rel is not null"))
    distinct = tri.where(whole).groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("n"))
    named = ents.where("name <> ''").groupBy(kg.normal(F.col("name")).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rel_named = rels.where("rel_name <> ''").groupBy("rel_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    parts = (
        ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("entity_duplicate_ids"),
            F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("entity_blank_ids"),
            F.coalesce(F.sum(F.when(~F.col("id").rlike(_E), F.col("n"))), F.lit(0)).alias("entity_malformed_ids"),
        ),
        ents.agg(
            count(F.col("name") == "").alias("entity_blank_names"), count(F.col("descr") == "").alias("entity_empty_descriptions"),
            count(audit.contains_any(descr, audit.NAVIGATION_PHRASES)).alias("entity_navigation_descriptions"), count(audit.contains_any(descr, audit.WIKI_MARKS)).alias("entity_wiki_descriptions"),
            count(audit.repetitive(F.col("descr"))).alias("entity_repetitive_descriptions"), count((F.col("aliases") != "") & blank_part).alias("entity_malformed_aliases"),
        ),
        rels.agg(
            (F.count("rel") - F.count_distinct("rel")).alias("relation_duplicate_ids"), count(F.col("rel").isNull()).alias("relation_blank_ids"), count(~F.col("rel").rlike(_R)).alias("relation_malformed_ids"), count(F.col("rel_name") == "").alias("relation_blank_names"),
        ),
        flagged.agg(
            count(whole & (F.col("src") == F.col("dst"))).alias("triple_self_loops"), count(~whole).alias("triple_malformed"), (count(whole & ~F.col("src").rlike(_E)) + count(whole & ~F.col("dst").rlike(_E))).alias("triple_invalid_entity_ids"),
            count(whole & ~F.col("rel").rlike(_R)).alias("triple_invalid_relation_ids"), count(whole & ~(F.col("has_src") & F.col("has_dst"))).alias("triple_missing_entities"), count(whole & ~F.col("has_rel")).alias("triple_missing_relations"),
        ),
        distinct.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("triple_duplicates")),
        total(named).toDF("entity_duplicate_names"), total(rel_named).toDF("relation_duplicate_names"),
        rels.where("rel is not null").join(edges.select("rel"), "rel", "left_anti").agg(F.count(F.lit(1)).alias("relation_unused")),
        known.join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("entity_isolated")),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def graph_verdict(spark, d):
    """``rule, level, n, passed`` of every rule; a graph passes if no rule of level ``fail`` is broken."""
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"), F.col(name).cast("bigint").alias("n")) for name, level in LEVELS.items()])
    return broken(spark, d).select(F.inline(rules)).withColumn("passed", F.col("n") == 0)


def verdict_report(spark, d):
    """The verdict as lines of text, failures first: ``nth, line``."""
    v = graph_verdict(spark, d).where(~F.col("passed")).select(F.col("level"), "rule", "n")
    failed = v.agg(F.count_if(F.col("level") == "fail").alias("f"), F.sort_array(F.collect_list(F.struct("level", "rule", "n"))).alias("rows"))  # at most one row a rule
    head = F.format_string("verdict: %s", F.when(F.col("f") == 0, "passed").otherwise("failed"))
    lines = F.transform("rows", lambda r: F.format_string("%s %s: %d", r["level"], r["rule"], r["n"]))
    return failed.select(F.posexplode(F.concat(F.array(head), lines)).alias("nth", "line"))


_WITH = f"WITH {EDGES}, whl AS (SELECT * FROM tri WHERE src IS NOT NULL AND rel IS NOT NULL AND dst IS NOT NULL)"
_ROWS = " UNION ALL ".join(f"SELECT '{name}' AS rule, '{level}' AS level, CAST(({sql}) AS BIGINT) AS n" for name, level, sql in RULES)
QUERIES = {f.__name__: f for f in (graph_verdict, verdict_report)}
SQL = {
    "graph_verdict": f"{_WITH} SELECT rule, level, n, n = 0 AS passed FROM ({_ROWS})",
    "verdict_report": f"{_WITH}, b AS (SELECT rule, level, n, row_number() OVER (ORDER BY level, rule) AS nth FROM ({_ROWS}) WHERE n > 0) SELECT CAST(nth AS INT) AS nth, level || ' ' || rule || ': ' || n AS line FROM b UNION ALL SELECT 0, 'verdict: ' || CASE WHEN count(*) FILTER (level = 'fail') = 0 THEN 'passed' ELSE 'failed' END FROM b",
}
