"""Queries that audit, clean and compare the tables, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.operators import audit, kg
from knotwork.plans.sqlparts import ALIASES, EDGES, ENT, MEM, REL, SOUND, TRI, cid, norm
from knotwork.sources import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _any(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _case(column: str, ranges) -> str:
    return "CASE " + " ".join(f"WHEN {column} BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in ranges) + f" ELSE '>{ranges[-1][1]}' END"


_FLAGS = f"{SOUND}, flg AS (SELECT *, coalesce(src IN (SELECT id FROM ent), false) AS has_src, coalesce(dst IN (SELECT id FROM ent), false) AS has_dst, coalesce(rel IN (SELECT rel FROM rl), false) AS has_rel FROM tri)"
_MISSING = f"{_FLAGS}, mis AS (SELECT 'src' AS field, src AS id FROM flg WHERE NOT has_src UNION ALL SELECT 'rel', rel FROM flg WHERE NOT has_rel UNION ALL SELECT 'dst', dst FROM flg WHERE NOT has_dst), msn AS (SELECT field, id, count(*) AS n FROM mis WHERE id IS NOT NULL GROUP BY field, id)"


def _flags(spark, d):
    return audit.presence(kg.triples(spark, d), kg.deliveries(spark, d), kg.relations(spark, d))


@query(f"WITH {ENT} SELECT id, name, len({ALIASES}) AS n_aliases, length(descr) AS descr_chars FROM ent")
def kg_entities_load(spark, d):
    return kg.entities(spark, d).select("id", "name", F.size(kg.alias_list("aliases")).cast("bigint").alias("n_aliases"), F.length("descr").cast("bigint").alias("descr_chars"))


@query(f"WITH {SOUND} SELECT triple_id, src, rel, dst FROM snd")
def triples_ref_clean(spark, d):
    return kg.sound_triples(spark, d)


@query(f"WITH {_MISSING} SELECT field, id, n FROM msn")
def triples_missing_ids(spark, d):
    return audit.missing_counts(_flags(spark, d))


@query(f"WITH {_MISSING} SELECT field, id, n, nth FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, id) AS nth FROM msn) WHERE nth <= 20")
def missing_ids_top(spark, d):
    return audit.first_per_class(audit.missing_counts(_flags(spark, d)), "field", [F.desc("n"), "id"], 20)


@query(f"WITH {_MISSING} SELECT field, triple_id, nth FROM (SELECT field, triple_id, row_number() OVER (PARTITION BY field ORDER BY triple_id) AS nth FROM (SELECT 'src' AS field, triple_id FROM flg WHERE NOT has_src AND src IS NOT NULL UNION ALL SELECT 'rel', triple_id FROM flg WHERE NOT has_rel AND rel IS NOT NULL UNION ALL SELECT 'dst', triple_id FROM flg WHERE NOT has_dst AND dst IS NOT NULL)) WHERE nth <= 10")
def missing_samples(spark, d):
    flags = _flags(spark, d)
    kinds = F.array(*[F.when(~F.col(f"has_{f}") & F.col(f).isNotNull(), F.lit(f)) for f in ("src", "rel", "dst")])
    rows = flags.select("triple_id", F.explode(kinds).alias("field")).where("field is not null")
    return audit.first_per_class(rows, "field", ["triple_id"], 10)


@query(f"WITH {_FLAGS} SELECT count(*) AS n_rows, count(*) FILTER (NOT w) AS n_malformed, count(*) FILTER (w AND NOT has_src) AS n_missing_src, count(*) FILTER (w AND NOT has_dst) AS n_missing_dst, count(*) FILTER (w AND NOT has_src AND NOT has_dst) AS n_missing_both, count(*) FILTER (w AND NOT has_rel) AS n_missing_rel, count(*) FILTER (w AND src = dst) AS n_self_loops, count(*) FILTER (w AND has_src AND has_rel AND has_dst) AS n_kept FROM (SELECT *, src IS NOT NULL AND rel IS NOT NULL AND dst IS NOT NULL AS w FROM flg)")
def triple_integrity_summary(spark, d):
    return audit.integrity(_flags(spark, d))


@query(f"WITH {REL}, {TRI} SELECT coalesce(r.rel_name, t.rel) AS relation, count(*) AS n FROM tri t LEFT JOIN rl r ON r.rel = t.rel WHERE t.src = t.dst AND t.rel IS NOT NULL GROUP BY 1")
def self_loops_by_relation(spark, d):
    loops = kg.triples(spark, d).where("src = dst and rel is not null")
    return loops.join(kg.relations(spark, d), "rel", "left").groupBy(F.coalesce("rel_name", "rel").alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SOUND} SELECT src, rel, dst, count(*) AS n FROM snd GROUP BY ALL HAVING count(*) > 1")
def duplicate_triples(spark, d):
    return kg.sound_triples(spark, d).groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {SOUND} SELECT count(*) AS n_rows, count(DISTINCT (src, rel, dst)) AS n_unique, count(*) - count(DISTINCT (src, rel, dst)) AS n_duplicates FROM snd")
def triple_uniqueness(spark, d):
    per = kg.sound_triples(spark, d).groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique"))


_DEG = f"{EDGES}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edg UNION ALL SELECT dst FROM edg) GROUP BY id)"


@query(f"WITH {_DEG} SELECT count(*) AS n_nodes, min(degree) AS min_degree, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree FROM deg")
def degree_stats(spark, d):
    return audit.degrees(kg.edges(spark, d)).agg(F.count(F.lit(1)).alias("n_nodes"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"))


@query(f"WITH {_DEG} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 20")
def degree_topk(spark, d):
    return audit.degrees(kg.edges(spark, d)).orderBy(F.desc("degree"), "id").limit(20)


@query(f"WITH {EDGES} SELECT (SELECT count(*) FROM ent) AS n_entities, (SELECT count(*) FROM ent WHERE id NOT IN (SELECT src FROM edg UNION SELECT dst FROM edg)) AS n_isolated, (SELECT count(*) FROM rl) AS n_relations, (SELECT count(*) FROM rl WHERE rel NOT IN (SELECT rel FROM edg)) AS n_unused")
def coverage_isolated_unused(spark, d):
    edges = kg.edges(spark, d)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("used", F.lit(1))
    ents = kg.deliveries(spark, d).select("id").distinct().join(ends, "id", "left").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("used").isNull()).alias("n_isolated"))
    rels = kg.relations(spark, d).join(edges.select("rel").distinct().withColumn("used", F.lit(1)), "rel", "left").agg(F.count(F.lit(1)).alias("n_relations"), F.count_if(F.col("used").isNull()).alias("n_unused"))
    return ents.withColumn("one", F.lit(1)).join(rels.withColumn("one", F.lit(1)), "one").drop("one")


@query(f"WITH {EDGES} SELECT DISTINCT id FROM ent WHERE id NOT IN (SELECT src FROM edg UNION SELECT dst FROM edg)")
def isolated_entities(spark, d):
    ends = kg.edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id"))
    return kg.deliveries(spark, d).select("id").distinct().join(ends, "id", "left_anti")


@query(f"WITH {SOUND} SELECT rel, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM snd), 6) AS pct FROM snd GROUP BY rel")
def relation_usage_share(spark, d):
    sound = kg.sound_triples(spark, d).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    return sound.withColumn("pct", F.round(100.0 * F.col("n") / sound.agg(F.sum("n")).scalar(), 6))


@query(f"WITH {SOUND} SELECT rel IN ({', '.join(repr(r) for r in audit.HUB_RELATIONS)}) AS is_hub, count(*) AS n FROM snd GROUP BY 1")
def hub_filter_counts(spark, d):
    return kg.sound_triples(spark, d).groupBy(F.col("rel").isin(*audit.HUB_RELATIONS).alias("is_hub")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRI} SELECT count(*) FILTER (regexp_matches(src, '{audit.ENTITY_ID}')) AS ok_src, count(*) FILTER (regexp_matches(rel, '{audit.RELATION_ID}')) AS ok_rel, count(*) FILTER (regexp_matches(dst, '{audit.ENTITY_ID}')) AS ok_dst, count(*) AS n FROM tri")
def id_format_check(spark, d):
    t = kg.triples(spark, d)
    return t.agg(F.count_if(F.col("src").rlike(audit.ENTITY_ID)).alias("ok_src"), F.count_if(F.col("rel").rlike(audit.RELATION_ID)).alias("ok_rel"), F.count_if(F.col("dst").rlike(audit.ENTITY_ID)).alias("ok_dst"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRI} SELECT triple_id FROM tri WHERE src IS NULL OR rel IS NULL OR dst IS NULL")
def malformed_triples(spark, d):
    return kg.triples(spark, d).where("src is null or rel is null or dst is null").select("triple_id")


@query(f"WITH {ENT} SELECT count(*) AS n_names, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT {norm('name')} AS k, count(*) AS n FROM ent WHERE name <> '' GROUP BY 1 HAVING count(*) > 1)")
def duplicate_name_rows(spark, d):
    names = kg.entities(spark, d).where("name <> ''").groupBy(kg.normal(F.col("name")).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return names.agg(F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_rows"))


@query(f"WITH {ENT} SELECT {_case('n', audit.ALIAS_BUCKETS)} AS bucket, count(*) AS n FROM (SELECT len({ALIASES}) AS n FROM ent) GROUP BY 1")
def alias_buckets(spark, d):
    return kg.entities(spark, d).groupBy(audit.bucket(F.size(kg.alias_list("aliases")), audit.ALIAS_BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENT}, al AS (SELECT {ALIASES} AS a, {norm('name')} AS nm FROM ent), k AS (SELECT list_transform(a, lambda x: {norm('x')}) AS a, nm FROM al) SELECT count(*) AS n_entities, round(avg(len(a)), 6) AS avg_aliases, count(*) FILTER (len(list_distinct(a)) < len(a)) AS n_with_duplicates, count(*) FILTER (list_contains(a, nm)) AS n_name_as_alias FROM k")
def alias_audit(spark, d):
    keys = F.transform(kg.alias_list("aliases"), kg.normal)
    e = kg.entities(spark, d).select(keys.alias("a"), kg.normal(F.col("name")).alias("nm"))
    return e.agg(F.count(F.lit(1)).alias("n_entities"), F.round(F.avg(F.size("a")), 6).alias("avg_aliases"), F.count_if(F.size(F.array_distinct("a")) < F.size("a")).alias("n_with_duplicates"), F.count_if(F.array_contains("a", F.col("nm"))).alias("n_name_as_alias"))


_CLEAN = f"""{ENT}, al AS (SELECT id, name, CASE WHEN aliases = '' THEN 0 ELSE len(string_split(aliases, '|')) END AS n_raw, {ALIASES} AS a FROM ent),
ot AS (SELECT id, n_raw, len(a) AS n_listed, list_filter(a, lambda x: {norm('x')} <> {norm('name')}) AS o FROM al),
cl AS (SELECT id, n_raw, n_listed, len(o) AS n_other, list_filter(o, lambda x, i: list_position(list_transform(o, lambda y: {norm('y')}), {norm('x')}) = i) AS kept FROM ot)"""


@query(f"WITH {_CLEAN} SELECT id, array_to_string(kept, '|') AS kept, n_raw - n_listed AS n_blank, n_listed - n_other AS n_canonical, n_other - len(kept) AS n_duplicate FROM cl")
def alias_clean(spark, d):
    c = audit.clean_aliases(kg.entities(spark, d))
    return c.select("id", F.array_join("kept", "|").alias("kept"), *[F.col(n).cast("bigint").alias(n) for n in ("n_blank", "n_canonical", "n_duplicate")])


@query(f"WITH {_CLEAN}, ea AS (SELECT id, len(kept) AS n, unnest(kept) AS alias FROM cl) SELECT * FROM (SELECT id, alias, CASE WHEN {_any(norm('alias'), audit.ARCHIVE_WORDS)} THEN 'archive' WHEN regexp_full_match(alias, '[^\\p{{L}}\\p{{N}}]+') THEN 'symbols' WHEN n >= {audit.MANY_ALIASES} THEN 'many' END AS reason FROM ea) WHERE reason IS NOT NULL")
def alias_suspicious(spark, d):
    return audit.suspicious_aliases(audit.clean_aliases(kg.entities(spark, d)))


@query(f"WITH {ENT} SELECT {_case('length(descr)', audit.LENGTH_BUCKETS)} AS bucket, count(*) AS n FROM ent GROUP BY 1")
def desc_buckets(spark, d):
    return kg.entities(spark, d).groupBy(audit.bucket(F.length("descr"), audit.LENGTH_BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENT} SELECT id FROM ent WHERE {_any(norm('descr'), audit.NAVIGATION_PHRASES)}")
def desc_navigation(spark, d):
    return kg.entities(spark, d).where(audit.contains_any(kg.normal(F.col("descr")), audit.NAVIGATION_PHRASES)).select("id")


@query(f"WITH {ENT} SELECT id FROM ent WHERE {_any(norm('descr'), audit.WIKI_MARKS)}")
def desc_wiki_artifacts(spark, d):
    return kg.entities(spark, d).where(audit.contains_any(kg.normal(F.col("descr")), audit.WIKI_MARKS)).select("id")


@query(f"WITH {ENT}, w AS (SELECT id, list_filter(string_split({norm('descr')}, ' '), lambda x: x <> '') AS w FROM ent) SELECT id FROM w WHERE len(w) >= 8 AND len(list_distinct(w)) < CAST(0.45 AS DOUBLE) * len(w)")
def desc_repetitive(spark, d):
    return kg.entities(spark, d).where(audit.repetitive(F.col("descr"))).select("id")


_LAST = f"{ENT}, lst AS (SELECT id, name, aliases, descr FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id DESC) AS rn FROM dlv) WHERE rn = 1)"


def _diff(f: str) -> str:
    return f"CASE WHEN a.{f} = b.{f} THEN 'unchanged' WHEN a.{f} = '' THEN 'added' WHEN b.{f} = '' THEN 'removed' ELSE 'changed' END"


@query(f"WITH {_LAST}, b AS (SELECT * FROM lst WHERE name <> ''), a AS (SELECT * FROM ent WHERE descr <> ''), j AS (SELECT a.id AS ia, b.id AS ib, {_diff('name')} AS name, {_diff('aliases')} AS aliases, {_diff('descr')} AS descr FROM a FULL JOIN b ON a.id = b.id) SELECT 'entity' AS field, CASE WHEN ia IS NULL THEN 'added' WHEN ib IS NULL THEN 'removed' ELSE 'common' END AS change, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'name', name, count(*) FROM j WHERE ia = ib GROUP BY ALL UNION ALL SELECT 'aliases', aliases, count(*) FROM j WHERE ia = ib GROUP BY ALL UNION ALL SELECT 'descr', descr, count(*) FROM j WHERE ia = ib GROUP BY ALL")
def dataset_diff_entities(spark, d):
    """First deliveries with a description against last deliveries with a name."""
    return audit.compare_entities(kg.entities(spark, d).where("descr <> ''"), kg.entities(spark, d, latest=True).where("name <> ''"))


@query(f"WITH {EDGES}, raw AS (SELECT DISTINCT src, rel, dst FROM tri), fin AS (SELECT * FROM edg WHERE src <> dst) SELECT (SELECT count(*) FROM raw) AS n_before, (SELECT count(*) FROM fin) AS n_after, (SELECT count(*) FROM raw) - (SELECT count(*) FROM fin) AS n_removed, round(100.0 * (SELECT count(*) FROM fin) / (SELECT count(*) FROM raw), 6) AS preserved_pct")
def dataset_diff_triples(spark, d):
    """All distinct triples before cleaning against distinct sound triples without loops after it."""
    before = kg.triples(spark, d).select("src", "rel", "dst").distinct().agg(F.count(F.lit(1)).alias("n_before"))
    after = kg.edges(spark, d).where("src <> dst").agg(F.count(F.lit(1)))
    out = before.select("n_before", after.scalar().alias("n_after"))
    return out.select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"), F.round(100.0 * F.col("n_after") / F.col("n_before"), 6).alias("preserved_pct"))


@query(f"WITH {_FLAGS}, m AS (SELECT count(*) FILTER (NOT w) AS malformed, count(*) FILTER (w AND NOT (has_src AND has_dst AND has_rel)) AS dangling, count(*) FILTER (w AND src = dst) AS loops FROM (SELECT *, src IS NOT NULL AND rel IS NOT NULL AND dst IS NOT NULL AS w FROM flg)) SELECT 'malformed' AS rule, 'fail' AS level, malformed AS n, malformed = 0 AS passed FROM m UNION ALL SELECT 'dangling', 'fail', dangling, dangling = 0 FROM m UNION ALL SELECT 'self_loops', 'warn', loops, loops = 0 FROM m")
def sanity_verdict(spark, d):
    whole = F.col("src").isNotNull() & F.col("rel").isNotNull() & F.col("dst").isNotNull()
    m = _flags(spark, d).agg(F.count_if(~whole).alias("malformed"), F.count_if(whole & ~(F.col("has_src") & F.col("has_dst") & F.col("has_rel"))).alias("dangling"), F.count_if(whole & (F.col("src") == F.col("dst"))).alias("loops"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(level).alias("level"), F.col(c).alias("n")) for r, level, c in (("malformed", "fail", "malformed"), ("dangling", "fail", "dangling"), ("self_loops", "warn", "loops"))])
    return m.select(F.inline(rules)).withColumn("passed", F.col("n") == 0)


@query(f"WITH {ENT}, {MEM} SELECT e.id, e.name, m.pid FROM ent e LEFT JOIN mem m ON m.id = e.id")
def assignment_writeback(spark, d):
    return kg.entities(spark, d).select("id", "name").join(kg.members(spark, d), "id", "left")


@query(f"WITH {ENT}, {MEM} SELECT count(*) AS n_entities, count(m.pid) AS n_assigned, count(DISTINCT m.pid) AS n_partitions FROM ent e LEFT JOIN mem m ON m.id = e.id")
def assignment_verify(spark, d):
    ents = kg.deliveries(spark, d).select("id").distinct().join(kg.members(spark, d), "id", "left")
    per = ents.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_entities"), F.coalesce(F.sum(F.when(F.col("pid").isNotNull(), F.col("n"))), F.lit(0)).alias("n_assigned"), F.count("pid").alias("n_partitions"))


@query(f"WITH {ENT} SELECT id, name FROM ent WHERE contains(lower(name), lower('Harbour')) ORDER BY id LIMIT 25")
def entity_name_search(spark, d):
    return kg.entities(spark, d).where(F.lower("name").contains("harbour")).select("id", "name").orderBy("id").limit(25)


@query(f"WITH {ENT} SELECT name, count(*) AS n_rows, min(id) AS first_id FROM ent WHERE name <> '' GROUP BY name")
def entity_homonyms(spark, d):
    return kg.entities(spark, d).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"))


@query(f"SELECT {cid('entity_id')} AS id, CAST(max(len(entity_description)) AS BIGINT) AS longest FROM entities WHERE {cid('entity_id')} IS NOT NULL GROUP BY 1")
def longest_description(spark, d):
    return table(spark, d, "entities").select(kg.clean_id("entity_id").alias("id"), F.length("entity_description").cast("bigint").alias("n")).where("id is not null").groupBy("id").agg(F.max("n").alias("longest"))
