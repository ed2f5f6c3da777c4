"""Seed resolution runs over every test question, with the routed partitions as scope."""

import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from knotwork.operators import seeds
from knotwork.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def asked(tmp_path_factory):
    """The smallest tables with long questions that name an entity each; returns the folder and the ids named."""
    folder, named = tmp_path_factory.mktemp("asked"), {}
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        if not path.endswith("test_items.parquet"):
            os.symlink(path, folder / os.path.basename(path))
    items, ents = pd.read_parquet(f"{FOLDER}/test_items.parquet"), pd.read_parquet(f"{FOLDER}/entities.parquet").dropna(subset=["entity_id", "entity_name"]).sort_values("rec_id")
    ents["key"] = ents.entity_id.str.strip().str.upper()
    ents = ents.drop_duplicates("key")
    ents = ents[ents.entity_name.str.fullmatch(r"[A-Za-z]{3,} [A-Za-z]{3,}")]
    items = items.head(min(len(items), len(ents)))
    for k, (item, ent) in enumerate(zip(items.item_id, ents.itertuples())):
        items.loc[items.item_id == item, "question"] = f"In which of all the old towns far away from here did {ent.entity_name} keep {k} ships?"
        named[item] = ent.key
    items.to_parquet(folder / "test_items.parquet")
    return str(folder), named


def test_long_test_questions_find_the_entity_they_name(spark, asked):
    folder, named = asked
    found = {(r.qid, r.id) for r in catalogue.QUERIES["question_seed_candidates"](spark, folder).collect()}
    assert len(named) > 20 and set(named.items()) <= found
    assert {q for q, _ in found} == {r.qid for r in catalogue.QUERIES["question_seed_selection"](spark, folder).collect()}


def test_scope_is_each_questions_own(spark):
    ents = spark.createDataFrame([("Q1", "Ada Lovelace", "", "x"), ("Q2", "Ada Lovelace", "", "x")], "id string, name string, aliases string, descr string")
    members = spark.createDataFrame([("Q1", 1), ("Q2", 2)], "id string, pid int")
    long = "in which of all the old towns far away from here did the mathematician ada lovelace live"
    asked = spark.createDataFrame([(1, long), (2, long)], "qid bigint, question string")
    scope = spark.createDataFrame([(1, 2), (2, 1)], "qid bigint, pid int")
    best = {r.qid: r.id for r in seeds.select(seeds.score(asked, ents, members, scope)).where(F.col("rank") == 1).collect()}
    assert best == {1: "Q2", 2: "Q1"}
