"""The knowledge graph as DataFrames: unique entities and relations, raw and sound triples, membership.

Ids are compared trimmed and in upper case. Where several deliveries share an id, the one with the
smallest ``rec_id`` counts. Null texts are empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.ids import clean_id
from knotwork.sources import table


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery of an entity with an id: ``id, rec_id, name, aliases, descr``."""
    return table(spark, folder, "entities").select(clean_id("entity_id").alias("id"), "rec_id", _text("entity_name").alias("name"), F.coalesce("entity_aliases", F.lit("")).alias("aliases"), _text("entity_description").alias("descr")).where("id is not null")


def entities(spark: SparkSession, folder: str, latest: bool = False) -> DataFrame:
    """One row per id: ``id, name, aliases, descr`` of the first (or the last) delivery."""
    pick = F.max_by if latest else F.min_by
    return deliveries(spark, folder).groupBy("id").agg(pick(F.struct("name", "aliases", "descr"), "rec_id").alias("e")).select("id", "e.*")


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """``rel, rel_name``; ids are unique."""
    return table(spark, folder, "relations").select(clean_id("relation_id").alias("rel"), F.lower(_text("relation_name")).alias("rel_name"))


def triples(spark: SparkSession, folder: str) -> DataFrame:
    """Every row: ``triple_id, src, rel, dst`` with null for blank ids."""
    return table(spark, folder, "triples").select("triple_id", clean_id("entity_1_id").alias("src"), clean_id("relation_id").alias("rel"), clean_id("entity_2_id").alias("dst"))


def sound_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose three ids all exist. Self-loops stay."""
    known = table(spark, folder, "entities").select(clean_id("entity_id").alias("id")).where("id is not null").distinct()
    rels = relations(spark, folder).select("rel")
    return (
        triples(spark, folder).join(rels, "rel", "left_semi")
        .join(known.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select("triple_id", "src", "rel", "dst")
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct sound triples ``src, rel, dst``."""
    return sound_triples(spark, folder).select("src", "rel", "dst").distinct()


def members(spark: SparkSession, folder: str) -> DataFrame:
    """One partition per entity, the smallest: ``id, pid``."""
    rows = table(spark, folder, "entity_map").select(clean_id("entity_id").alias("id"), F.col("partition_id").cast("int").alias("pid"))
    return rows.where("id is not null and pid is not null").groupBy("id").agg(F.min("pid").alias("pid"))


def alias_list(col: Column | str) -> Column:
    """A ``|``-separated alias field as an array of trimmed, non-empty values."""
    value = F.col(col) if isinstance(col, str) else col
    return F.filter(F.transform(F.split(value, r"\|"), lambda a: F.trim(a)), lambda a: a != "")


def normal(col: Column) -> Column:
    """Lower case with runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def lookup(ents: DataFrame, key: Column | str) -> DataFrame:
    """The entity with that id, one row or none."""
    return ents.where(F.col("id") == (F.lit(key) if isinstance(key, str) else key)).limit(1)
