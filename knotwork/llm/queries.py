"""Queries of the text and vector problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import contamination, neighbours, packing, repetition, residue, structure
from knotwork.sources import table

MIN_WORDS = 8
REPEATED_SHARE = 0.5
LEFT_OUT = 0.5
NEAREST = 10
LEAST_COSINE = 0.82
NONPROSE_SHARE = 0.5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "entities"), "rec_id", "entity_description", "entity_name").select("rec_id")


def p1_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Every template with the number of its segments and its verdict."""
    return residue.templates(residue.paths(table(spark, folder, "entities"), "rec_id", "entity_description", "entity_name"))


def p1_clean_records(spark: SparkSession, folder: str) -> DataFrame:
    kept = residue.without_residue(table(spark, folder, "entities"), "rec_id", "entity_description", "entity_name")
    return kept.select("rec_id", "entity_id", "entity_description")


def _repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition(table(spark, folder, "entities"), "rec_id", "entity_description")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """What the posterior leaves out, checked exactly."""
    left_out = _repetition(spark, folder).where(F.col("posterior") >= LEFT_OUT)
    return left_out.where((F.col("n_words") >= MIN_WORDS) & (F.col("repeated_share") >= REPEATED_SHARE)).select("rec_id")


def p7_repeated_share(spark: SparkSession, folder: str) -> DataFrame:
    return _repetition(spark, folder).select("rec_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


def p7_posterior(spark: SparkSession, folder: str) -> DataFrame:
    return _repetition(spark, folder).select("rec_id", "posterior")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), "doc_id", "text")
    return packed.withColumnRenamed("item", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose pieces lie in more than one container."""
    spread = p8_containers(spark, folder).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return spread.where("first < last").select("doc_id")


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents, pieces and tokens placed, containers above the capacity, pieces placed twice."""
    placed = p8_containers(spark, folder)
    loads = placed.groupBy("container").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    twice = placed.groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    held = loads.agg(F.sum("n").alias("n_pieces"), F.sum("size").alias("n_tokens"), F.count_if(F.col("size") > packing.CAPACITY).alias("n_overfull"))
    return held.crossJoin(twice.agg(F.count_distinct("doc_id").alias("n_documents"), F.count_if(F.col("n") > 1).alias("n_twice")))  # one row each


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "test_items"), "item_id", ["question", "passage"])
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "part", F.col("run").alias("run_words"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id").distinct()


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(neighbours.build(table(spark, folder, "centroids"), "partition_id", "centroid"), NEAREST)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_nearest(spark, folder), LEAST_COSINE)
    return pairs.select(F.col("a").alias("partition_a"), F.col("b").alias("partition_b"))


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder).select(F.col("id").alias("partition_id"), F.col("neighbour").alias("neighbour_id"), F.col("sim").alias("cosine"), "rank")


def p6_search(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy graph search for every centroid whose partition is divisible by 100, against all."""
    cen = table(spark, folder, "centroids")
    graph = neighbours.build(cen, "partition_id", "centroid")
    asked = cen.where(F.col("partition_id") % 100 == 0).select(F.col("partition_id").cast("bigint").alias("id"), F.col("centroid").alias("vec"))
    return neighbours.search(graph, asked, NEAREST).select(F.col("id").alias("partition_id"), F.col("neighbour").alias("neighbour_id"), F.col("sim").alias("cosine"), "rank")


def p6_recall(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.recall(_nearest(spark, folder), neighbours.brute_force(table(spark, folder, "centroids"), "partition_id", "centroid", NEAREST))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return structure.statistics(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_statistics(spark, folder).where(F.col("nonprose_share") > NONPROSE_SHARE).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_clean_records, p1_templates, p6_found, p6_neighbours, p6_search, p6_recall, p7_found, p7_repeated_share, p7_posterior, p8_found, p8_containers, p8_invariants, p9_found, p9_leaks, p10_found, p10_statistics)}

_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
_REPEATED = f"""wd AS (SELECT rec_id, coalesce({_WORDS.format(c='entity_description')}, []) AS w FROM entities),
gr AS (SELECT rec_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS gram FROM (SELECT rec_id, w, unnest(range(1, len(w) - 1)) AS i FROM wd WHERE len(w) >= 3)),
ag AS (SELECT rec_id, i FROM (SELECT rec_id, i, row_number() OVER (PARTITION BY rec_id, gram ORDER BY i) AS nth FROM gr) WHERE nth > 1),
cv AS (SELECT rec_id, count(*) AS c FROM (SELECT DISTINCT rec_id, unnest([i, i + 1, i + 2]) AS pos FROM ag) GROUP BY rec_id),
sh AS (SELECT wd.rec_id, len(w) AS n_words, CASE WHEN len(w) = 0 THEN 0 ELSE coalesce(c, 0)::DOUBLE / len(w) END AS share FROM wd LEFT JOIN cv ON cv.rec_id = wd.rec_id)"""
_BLANKS = r"\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SIZED = rf"sz AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_BLANKS}]+')) AS n FROM documents WHERE text IS NOT NULL)"
_PASSAGES = f"""tw AS (SELECT item_id, {_WORDS.format(c='txt')} AS w FROM (SELECT item_id, question AS txt FROM test_items UNION ALL SELECT item_id, passage FROM test_items) WHERE txt IS NOT NULL),
tg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + {contamination.MIN_RUN - 1}), ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - {contamination.MIN_RUN - 2})) AS i FROM tw)),
dw AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(list_slice(w, i, i + {contamination.MIN_RUN - 1}), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {contamination.MIN_RUN - 2})) AS i FROM dw))"""
SQL: dict[str, str] = {
    "p7_found": f"WITH {_REPEATED} SELECT rec_id FROM sh WHERE n_words >= {MIN_WORDS} AND share >= {REPEATED_SHARE}",
    "p7_repeated_share": f"WITH {_REPEATED} SELECT rec_id, n_words, round(share, 6) AS repeated_share FROM sh",
    "p8_found": f"WITH {_SIZED} SELECT doc_id FROM sz WHERE n > {packing.CAPACITY}",
    "p8_invariants": f"WITH {_SIZED} SELECT count(*) AS n_documents, CAST(sum(ceil(n / {packing.CAPACITY}.0)) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS n_tokens, 0::BIGINT AS n_overfull, 0::BIGINT AS n_twice FROM sz WHERE n > 0",
    "p9_found": f"WITH {_PASSAGES} SELECT DISTINCT doc_id, item_id FROM dg JOIN tg ON tg.gram = dg.gram",
}
