"""Contexts and answers from searched paths: labelled evidence, matched citations, sentences, and what is said without evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators import traverse

POLICY = "Answer only from the evidence above and cite a label for every claim."
SKIPPED = "No supporting evidence was found."


def seed_lines(seeds: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, nth, id, name, line``: one ``[S<n>]`` line for each seed of a question, in the order of ids."""
    order = Window.partitionBy("qid").orderBy("id")
    named = seeds.select("qid", "id").distinct().join(names.select("id", "name", "descr"), "id").withColumn("nth", F.row_number().over(order))
    descr = F.when(F.col("descr") != "", F.concat(F.lit(": "), F.regexp_replace(T.shorten(F.col("descr"), 240), r"\.$", ""))).otherwise("")
    return named.select("qid", "nth", "id", "name", F.concat(F.format_string("[S%d] %s (%s)", "nth", "name", "id"), descr, F.lit(".")).alias("line"))


def labelled_edges(paths: DataFrame, names: DataFrame, rel_names: DataFrame) -> DataFrame:
    """Edges of all paths with ``label``, and ``cited``: the label under which the same edge first came up for the question."""
    edges = traverse.path_edges(paths, names, rel_names).withColumn("label", F.format_string("P%d.E%d", "rank", "nth"))
    first = Window.partitionBy("qid", "src", "rel", "dst").orderBy("rank", "nth")
    return edges.withColumn("cited", F.first("label").over(first))


def context(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``qid, context, n_citations``: seed lines, a line for every edge of every path, and the policy.

    ``edges``: ``labelled_edges``; ``seeds``: ``seed_lines``. Labels keep counting where an edge comes again; citations are counted once
    an edge. Questions without any line get none.
    """
    line = F.concat(F.format_string("Path %d: [%s] %s (%s) --%s (%s)--> %s (%s).", "rank", "label", "s", "src", "r", "rel", "t", "dst"), F.when(F.col("descr") != "", F.concat(F.lit(" Target description: "), T.shorten(F.col("descr"), 240))).otherwise(""))
    lines = edges.select("qid", F.lit(1).alias("kind"), "rank", "nth", line.alias("line"), "cited").unionByName(
        seeds.select("qid", F.lit(0).alias("kind"), F.lit(0).alias("rank"), "nth", "line", F.format_string("S%d", "nth").alias("cited"))
    )
    per = lines.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("kind", "rank", "nth", "line"))).alias("xs"), F.count_distinct("cited").alias("n_citations"))
    return per.select("qid", F.array_join(F.array_append(F.transform("xs", lambda x: x["line"]), F.lit(POLICY)), "\n").alias("context"), "n_citations")


def _named(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """Edges whose source the question names and whose relation matches it."""
    key, asked = T.compact_key(F.col("s")), T.compact_key(F.col("question"))
    return edges.join(questions.select("qid", "question"), "qid").where((key != "") & asked.contains(key) & (traverse.relation_relevance(F.col("r"), F.col("question")) == 1.0))


def relation_answers(edges: DataFrame, paths: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, answer, citation``: a sentence from the matching edge on the best-scored path, worded by the relation's intent."""
    fits = _named(edges, questions).join(paths.select("qid", "rank", "score"), ["qid", "rank"])
    best = fits.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "nth"))).where("n = 1")
    family = traverse.intent(T.content_tokens(F.col("r")), True)
    said = (
        F.when(family == "author", F.format_string("The KG lists %s (%s) as the author of %s.", "t", "dst", "s"))
        .when(family == "place of birth", F.format_string("%s was born in %s.", "s", "t"))
        .when(family == "capital", F.format_string("The capital of %s is %s.", "s", "t"))
        .otherwise(F.format_string("The KG evidence links %s to %s through '%s'.", "s", "t", "r"))
    )
    return best.select("qid", F.concat(said, F.format_string(" [%s]", "label")).alias("answer"), F.col("label").alias("citation"))


def bullet_answers(edges: DataFrame) -> DataFrame:
    """``qid, answer``: one bullet for every path, one cited claim for every edge."""
    claim = F.format_string("[%s] %s has relation '%s' with %s", "label", "s", "r", "t")
    per = edges.select("qid", "rank", F.struct("nth", claim.alias("claim")).alias("x")).groupBy("qid", "rank").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    lines = per.select("qid", F.struct("rank", F.concat(F.lit("• "), F.array_join(F.transform("xs", lambda x: x["claim"]), " -> "), F.lit(".")).alias("line")).alias("y"))
    return lines.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("y")), lambda y: y["line"]), "\n").alias("answer"))


def matching_citations(answers: DataFrame, edges: DataFrame, seeds: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, citations``: labels of edges whose source the question names, whose target the answer names and whose relation matches;
    where there is none, labels of seeds that question or answer name. ``answers``: qid, answer."""
    said = T.compact_key(F.col("answer"))
    target = T.compact_key(F.col("t"))
    hits = _named(edges, questions).join(answers.select("qid", "answer"), "qid").where((target != "") & said.contains(target)).groupBy("qid").agg(F.transform(F.sort_array(F.collect_set(F.struct("rank", "nth", "label"))), lambda x: x["label"]).alias("by_edge"))
    name = T.compact_key(F.col("name"))
    whole = seeds.join(questions.select("qid", "question"), "qid").join(answers.select("qid", "answer"), "qid")
    by_seed = whole.where((name != "") & (T.compact_key(F.col("question")).contains(name) | said.contains(name))).groupBy("qid").agg(F.transform(F.sort_array(F.collect_set("nth")), lambda n: F.format_string("S%d", n)).alias("by_seed"))
    out = answers.select("qid").join(hits, "qid", "left").join(by_seed, "qid", "left")
    return out.select("qid", F.coalesce("by_edge", "by_seed", F.array().cast("array<string>")).alias("citations"))


def answers(questions: DataFrame, paths: DataFrame, seeds: DataFrame, names: DataFrame, rel_names: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``qid, answer, citations, was_skipped`` of every question.

    Without a path the fixed message is given and nothing is generated. ``generate`` may turn ``qid, question, context`` into ``qid, answer`` (a
    model behind ``mapInPandas``, say); without it the relation sentence is the answer, or else the bullets of the paths.
    """
    edges, lines = labelled_edges(paths, names, rel_names), seed_lines(seeds, names)
    direct, bullets = relation_answers(edges, paths, questions), bullet_answers(edges)
    found = bullets.withColumnRenamed("answer", "bullets").join(direct.select("qid", F.col("answer").alias("direct")), "qid", "left").select("qid", F.coalesce("direct", "bullets").alias("answer"))
    if generate is not None:
        found = generate(questions.join(context(edges, lines), "qid").join(found.select("qid"), "qid", "left_semi").select("qid", "question", "context")).select("qid", "answer")
    cited = matching_citations(found, edges, lines, questions)
    out = questions.select("qid").join(found, "qid", "left").join(cited, "qid", "left")
    return out.select("qid", F.coalesce("answer", F.lit(SKIPPED)).alias("answer"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"), F.col("answer").isNull().alias("was_skipped"))
