"""Queries of the general data problems: p2 references, p3 heavy keys, p4 hierarchies, p5 packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.ids import clean_id
from knotwork.operators import hierarchy, packed, references, skew
from knotwork.sources import table

REFERENCE_FIELDS = {"entity_1_id": "entities", "relation_id": "relations", "entity_2_id": "entities"}
#: Child-to-parent relations; a relation that points from parent to child maps to the one whose hierarchy it states.
UPWARD = ("P2790", "P3610")
DOWNWARD = {"P5270": "P3610"}
HOT_SHARE = 0.03


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    parents = {"entities": (table(spark, folder, "entities"), "entity_id"), "relations": (table(spark, folder, "relations"), "relation_id")}
    return references.orphan_references(table(spark, folder, "triples"), "triple_id", "loaded_at", REFERENCE_FIELDS, parents)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select(F.col("row_id").alias("triple_id"), "field_name")


def p2_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphans_by_period(_orphans(spark, folder))


def _triple_profile(spark: SparkSession, folder: str) -> DataFrame:
    values = {"relations": clean_id("relation_id"), "objects": clean_id("entity_2_id")}
    return skew.key_profile(table(spark, folder, "triples"), clean_id("entity_1_id"), values)


def _partition_profile(spark: SparkSession, folder: str) -> DataFrame:
    return skew.key_profile(table(spark, folder, "entity_map"), F.col("partition_id"), {"entities": clean_id("entity_id")}, modes=False)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, profile in (("triples", _triple_profile), ("entity_map", _partition_profile)):
        rows = table(spark, folder, name).agg(F.count(F.lit(1)))
        parts.append(skew.hot_keys(profile(spark, folder), rows, HOT_SHARE).select(F.lit(name).alias("table_name"), F.col("key").alias("key_value")))
    return parts[0].unionByName(parts[1])


def p3_entity_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _triple_profile(spark, folder)


def p3_partition_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _partition_profile(spark, folder)


def _hierarchy_links(spark: SparkSession, folder: str) -> DataFrame:
    triples = table(spark, folder, "triples")
    rel = clean_id("relation_id")
    flip = rel.isin(*DOWNWARD)
    group = F.coalesce(*[F.when(rel == down, F.lit(up)) for down, up in DOWNWARD.items()], F.when(rel.isin(*UPWARD), rel))
    left, right = clean_id("entity_1_id"), clean_id("entity_2_id")
    return hierarchy.links(triples, group, F.when(flip, right).otherwise(left), F.when(flip, left).otherwise(right))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.unroll(_hierarchy_links(spark, folder), with_path=False)
    return tree.select(F.col("grp").alias("relation_id"), F.col("node").alias("entity_id"), F.col("root").alias("root_id"), "depth")


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.unroll(_hierarchy_links(spark, folder))
    return tree.select(F.col("grp").alias("relation_id"), F.col("node").alias("entity_id"), F.col("root").alias("root_id"), "depth", "path")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    pairs = hierarchy.descendants(hierarchy.unroll(_hierarchy_links(spark, folder)))
    return pairs.select(F.col("grp").alias("relation_id"), F.col("ancestor").alias("ancestor_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("bigint").alias("distance"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.explode_packed(table(spark, folder, "entities"), "rec_id", "entity_aliases")


QUERIES = {f.__name__: f for f in (p2_found, p2_orphans_by_month, p3_found, p3_entity_profile, p3_partition_profile, p4_found, p4_paths, p4_descendants, p5_found)}

_ID = "nullif(upper(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _id(column: str) -> str:
    return _ID.format(c=column)


_SPANS = f"""
spans AS (
  SELECT 'entities' AS table_name, {_id('entity_id')} AS k, min(loaded_at) AS came, min(deleted_at) AS gone FROM entities GROUP BY ALL
  UNION ALL
  SELECT 'relations', {_id('relation_id')}, min(loaded_at), min(deleted_at) FROM relations GROUP BY ALL
), refs AS (
  SELECT triple_id, 'entity_1_id' AS field_name, 'entities' AS table_name, {_id('entity_1_id')} AS k, loaded_at FROM triples
  UNION ALL SELECT triple_id, 'relation_id', 'relations', {_id('relation_id')}, loaded_at FROM triples
  UNION ALL SELECT triple_id, 'entity_2_id', 'entities', {_id('entity_2_id')}, loaded_at FROM triples
), misses AS (
  SELECT r.*, CASE WHEN s.came IS NULL THEN 'missing' WHEN s.came > r.loaded_at THEN 'late' ELSE 'deleted' END AS reason
  FROM refs r LEFT JOIN spans s ON r.table_name = s.table_name AND r.k = s.k
  WHERE r.k IS NOT NULL AND (s.came IS NULL OR s.came > r.loaded_at OR s.gone <= r.loaded_at)
)"""

_TREE = f"""
links AS (
  SELECT DISTINCT CASE WHEN r = 'P5270' THEN 'P3610' ELSE r END AS grp, CASE WHEN r = 'P5270' THEN b ELSE a END AS child, CASE WHEN r = 'P5270' THEN a ELSE b END AS parent
  FROM (SELECT {_id('entity_1_id')} AS a, {_id('relation_id')} AS r, {_id('entity_2_id')} AS b FROM triples)
  WHERE r IN ('P2790', 'P3610', 'P5270') AND a IS NOT NULL AND b IS NOT NULL
), nodes AS (SELECT grp, child AS node FROM links UNION SELECT grp, parent FROM links),
tree AS (
  SELECT grp, node, node AS root, 0 AS depth, node AS path FROM nodes WHERE (grp, node) NOT IN (SELECT (grp, child) FROM links)
  UNION ALL
  SELECT t.grp, l.child, t.root, t.depth + 1, t.path || '/' || l.child FROM tree t JOIN links l ON l.grp = t.grp AND l.parent = t.node
), everything AS (
  SELECT n.grp AS relation_id, n.node AS entity_id, coalesce(t.root, 'CYCLE') AS root_id, CAST(coalesce(t.depth, -1) AS BIGINT) AS depth, t.path
  FROM nodes n LEFT JOIN tree t ON n.grp = t.grp AND n.node = t.node
)"""

SQL = {
    "p2_found": f"WITH {_SPANS} SELECT triple_id, field_name FROM misses",
    "p2_orphans_by_month": f"WITH {_SPANS} SELECT table_name, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS n_references FROM misses GROUP BY ALL",
    "p3_found": f"""
SELECT 'triples' AS table_name, {_id('entity_1_id')} AS key_value FROM triples GROUP BY 2
HAVING {_id('entity_1_id')} IS NOT NULL AND count(*) >= 0.03 * (SELECT count(*) FROM triples)
UNION ALL
SELECT 'entity_map', CAST(partition_id AS VARCHAR) FROM entity_map GROUP BY partition_id
HAVING partition_id IS NOT NULL AND count(*) >= 0.03 * (SELECT count(*) FROM entity_map)""",
    "p3_entity_profile": f"""
WITH t AS (SELECT {_id('entity_1_id')} AS key, {_id('relation_id')} AS r, {_id('entity_2_id')} AS o FROM triples),
mode_r AS (SELECT key, r, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, r) AS i FROM t WHERE r IS NOT NULL GROUP BY key, r),
mode_o AS (SELECT key, o, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, o) AS i FROM t WHERE o IS NOT NULL GROUP BY key, o)
SELECT t.key, count(*) AS n_rows, count(DISTINCT t.r) AS n_relations, any_value(mr.r) AS top_relations, any_value(mr.n) AS top_relations_rows,
  count(DISTINCT t.o) AS n_objects, any_value(mo.o) AS top_objects, any_value(mo.n) AS top_objects_rows
FROM t LEFT JOIN mode_r mr ON mr.key = t.key AND mr.i = 1 LEFT JOIN mode_o mo ON mo.key = t.key AND mo.i = 1
WHERE t.key IS NOT NULL GROUP BY t.key""",
    "p3_partition_profile": f"SELECT CAST(partition_id AS VARCHAR) AS key, count(*) AS n_rows, count(DISTINCT {_id('entity_id')}) AS n_entities FROM entity_map WHERE partition_id IS NOT NULL GROUP BY partition_id",
    "p4_found": f"WITH RECURSIVE {_TREE} SELECT relation_id, entity_id, root_id, depth FROM everything",
    "p4_paths": f"WITH RECURSIVE {_TREE} SELECT relation_id, entity_id, root_id, depth, path FROM everything",
    "p4_descendants": f"""
WITH RECURSIVE {_TREE} SELECT grp AS relation_id, unnest(list_slice(string_split(path, '/'), 1, depth)) AS ancestor_id, node AS descendant_id,
  CAST(depth - unnest(range(depth)) AS BIGINT) AS distance FROM tree WHERE depth > 0""",
}
