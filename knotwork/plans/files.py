"""Queries that write tables as text and read them again; the SQL gives the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from knotwork.session import shared_folder
from knotwork.sources import files, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT relation_id, relation_name FROM relations")
def csv_relations(spark, d):
    path = _place(spark, "relations")
    files.write_csv(table(spark, d, "relations").select("relation_id", "relation_name"), path)
    return files.read_csv(spark, path, "relation_id string, relation_name string")


@query("SELECT item_id, question, passage, q_entity, answer, grounding FROM test_items")
def tsv_questions(spark, d):
    """Questions written twice, read keyed by id: the later version of each row wins."""
    path = _place(spark, "questions")
    t = table(spark, d, "test_items").select("item_id", "question", "passage", "q_entity", "answer", "grounding")
    files.write_csv(t.withColumn("question", F.lit("old")).withColumn("version", F.lit(1)).unionByName(t.withColumn("version", F.lit(2))), path, "\t")
    schema = "item_id bigint, question string, passage string, q_entity string, answer string, grounding string, version int"
    return files.read_keyed(spark, path, schema, "item_id", "version").drop("version")


@query("SELECT doc_id, text, n_chars FROM documents")
def jsonl_documents(spark, d):
    path = _place(spark, "documents")
    table(spark, d, "documents").select("doc_id", "text", "n_chars").write.json(path)
    return files.read_json_lines(spark, path, "doc_id bigint, text string, n_chars bigint")


@query("SELECT DISTINCT partition_id FROM entity_map WHERE partition_id IS NOT NULL")
def resumed_load(spark, d):
    """A load in two overlapping parts: each key is written once."""
    path = _place(spark, "load")
    m = table(spark, d, "entity_map").select("partition_id")
    files.append_new(m.where("partition_id % 3 = 0"), path, "partition_id")
    files.append_new(m, path, "partition_id")
    return spark.read.parquet(path)
