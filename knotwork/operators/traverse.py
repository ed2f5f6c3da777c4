"""Bounded path search from seed entities, for a whole batch of questions at once.

One row is one state of one question's beam. A hop joins the states to the outgoing edges of their last
node, scores each state's candidates among themselves and keeps the best states of every question.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators.retrieval import B, K1
from knotwork.operators.vectors import hash_coordinates
from knotwork.session import Workspace

# Structural relation words and the words that tell a relation's or a question's intent.
STRUCTURAL_TERMS = ("administrative", "described", "given", "instance", "source", "subclass", "taxon", "time", "timezone")
INTENTS = {
    "author": ("author", "authored", "creator", "wrote", "writes", "written", "writer"),
    "place of birth": ("birthplace", "born", "birth"),
    "date of birth": ("birthdate", "birthday", "born", "birth"),
    "capital": ("capital", "city"),
    "located in": ("located", "location", "where"),
    "founder": ("founder", "founded", "founding", "co-founder", "co-founded", "established"),
    "manufacturer": ("manufacturer", "manufactured", "manufacturing", "developer", "developed"),
    "director": ("director", "directed", "directing"),
}
# Phrases of questions that need a bridge.
MULTI_HOP = (
    "where the", "of the country", "of the founder", "birthplace of", "headquarters of", "developer of", "creator of", "who played",
    "coordinates of", "discoverer of", "inventor of", "graduate from", "situated at", "flows through",
)


@dataclass(frozen=True)
class Bounds:
    hops: int = 2
    beam: int = 5
    neighbours: int = 100
    paths: int = 3
    dense_weight: float = 0.35
    lexical_weight: float = 0.35
    relation_weight: float = 0.20
    novelty: float = 0.10
    hop_cost: float = 0.05

    def __post_init__(self) -> None:
        if min(self.hops, self.beam, self.neighbours, self.paths) < 1 or min(self.dense_weight, self.lexical_weight, self.relation_weight) < 0:
            raise ValueError("bounds must be positive and weights must not be negative")


def limits(questions: DataFrame, seeds: DataFrame, bounds: Bounds = Bounds(), per_seed: int = 3) -> DataFrame:
    """``qid, hops, width, n_paths`` of each question: 15 states and 12 paths where it asks for a set, 3 hops and at least
    12 states where it needs a bridge, and never less than ``per_seed`` states a seed."""
    many, multi = F.lower("question").rlike(T.AGGREGATION), T.any_of(F.lower("question"), MULTI_HOP)
    n = seeds.groupBy("qid").agg(F.count_distinct("id").alias("n"))
    width = F.greatest(F.when(many, 15).otherwise(bounds.beam), F.when(multi, 12).otherwise(bounds.beam), per_seed * F.coalesce("n", F.lit(0)))
    return questions.join(n, "qid", "left").select("qid", F.when(multi, 3).otherwise(bounds.hops).alias("hops"), width.alias("width"), F.when(many, 12).otherwise(bounds.paths).alias("n_paths"))


def intent(tokens: Column, with_name: bool) -> Column:
    """The first intent family that shares a word with the tokens; a relation may also match by the family's own words."""
    out = None
    for name, terms in INTENTS.items():
        words = [w for t in terms for w in t.split("-")] + ([w for w in name.split() if w not in T.STOP_WORDS and w != "in"] if with_name else [])
        hit = F.arrays_overlap(tokens, F.array(*map(F.lit, dict.fromkeys(words))))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def relation_relevance(relation: Column, question: Column) -> Column:
    """1 where relation and question agree in intent or share a content word, 0 for structural relations, else 0.25."""
    r, q = T.content_tokens(relation), T.content_tokens(question)
    ri, qi = intent(r, True), intent(q, False)
    match = F.when(ri.isNotNull() & qi.isNotNull(), ri == qi).otherwise(F.arrays_overlap(r, q))
    return F.when(match, 1.0).when(F.arrays_overlap(r, F.array(*map(F.lit, STRUCTURAL_TERMS))), 0.0).otherwise(0.25)


def neighbours(states: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Candidates ``state, src, rel, dst``: the first ``limit`` outgoing edges of each state's node by target and relation.

    ``states``: state, node, visited. Targets already visited are left out. A node that many states share meets its
    edges once: edges are cut to the limit plus the longest path per source before the join.
    """
    spare = states.agg(F.max(F.size("visited"))).first()[0] or 0
    order = Window.partitionBy("src").orderBy("dst", "rel")
    here = edges.join(states.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    near = here.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit + spare).drop("nth")
    met = states.join(near, F.col("node") == F.col("src")).where(~F.array_contains("visited", F.col("dst")))
    cut = Window.partitionBy("state").orderBy("dst", "rel")
    return met.withColumn("nth", F.row_number().over(cut)).where(F.col("nth") <= limit).drop("nth", "node", "visited")


def edge_scores(cands: DataFrame, questions: DataFrame, bounds: Bounds) -> DataFrame:
    """Adds ``dense, lexical, relevance, edge_score``; cands: qid, state, edge, relation, text; questions: qid, question.

    Dense and lexical scores are scaled to [0, 1] among the candidates of one state, 0 where all are equal.
    """
    toks = cands.select("qid", "state", "edge", F.explode(T.content_tokens(F.col("text"))).alias("token"))
    tf = toks.groupBy("qid", "state", "edge", "token").agg(F.count(F.lit(1)).alias("tf"))
    dl = tf.groupBy("state", "edge").agg(F.sum("tf").alias("dl"))
    sizes = cands.select("state", "edge").join(dl, ["state", "edge"], "left").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avg_dl"))
    df = tf.groupBy("state", "token").agg(F.count(F.lit(1)).alias("df"))
    terms = questions.select("qid", F.explode(F.array_distinct(T.content_tokens(F.col("question")))).alias("token"))
    met = tf.join(terms, ["qid", "token"]).join(df, ["state", "token"]).join(dl, ["state", "edge"]).join(sizes, "state")
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    lexical = met.groupBy("state", "edge").agg(F.round(F.sum(weight), 9).alias("lexical"))
    texts = cands.select("edge", "text").distinct()
    e = hash_coordinates(texts.select("edge", F.explode(T.tokens(F.col("text"))).alias("token")), "edge", "token")
    q = hash_coordinates(questions.select("qid", F.explode(T.tokens(F.col("question"))).alias("token")), "qid", "token")
    pairs = cands.select("qid", "state", "edge").join(e, "edge").join(q.withColumnRenamed("val", "qval"), ["qid", "dim"])
    dense = pairs.groupBy("state", "edge").agg(F.round(F.sum(F.col("val") * F.col("qval")), 9).alias("dense"))
    out = cands.join(questions, "qid").join(lexical, ["state", "edge"], "left").join(dense, ["state", "edge"], "left")
    out = out.withColumns({"lexical": F.coalesce("lexical", F.lit(0.0)), "dense": F.coalesce("dense", F.lit(0.0)), "relevance": relation_relevance(F.col("relation"), F.col("question"))})
    w = Window.partitionBy("state")

    def scaled(name: str) -> Column:
        low, high = F.min(name).over(w), F.max(name).over(w)
        return F.when(high == low, 0.0).otherwise((F.col(name) - low) / (high - low))

    score = bounds.dense_weight * scaled("dense") + bounds.lexical_weight * scaled("lexical") + bounds.relation_weight * F.col("relevance")
    return out.withColumn("edge_score", F.round(score, 9)).drop("question")


def start(seeds: DataFrame) -> DataFrame:
    """Beam states of ``qid, id``: qid, state, node, visited, rels, score, hop 0."""
    s = seeds.select("qid", "id").distinct()
    return s.select("qid", F.concat_ws(":", F.col("qid").cast("string"), "id").alias("state"), F.col("id").alias("node"), F.array("id").alias("visited"), F.array().cast("array<string>").alias("rels"), F.lit(0.0).alias("score"), F.lit(0).alias("hop"))


def hop(beam: DataFrame, edges: DataFrame, names: DataFrame, rel_names: DataFrame, questions: DataFrame, bounds: Bounds, own: DataFrame | None = None) -> DataFrame:
    """The next beam. ``names``: id, name, descr; ``rel_names``: rel, rel_name; ``own``: ``limits`` of each question."""
    cands = neighbours(beam.select("state", "node", "visited"), edges, bounds.neighbours).join(beam, "state")
    cands = cands.join(rel_names, "rel", "left").join(names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("descr")), "dst", "left")
    text = F.concat_ws(" ", "src_name", "rel_name", "dst_name", "descr")
    cands = cands.select("qid", "state", "visited", "rels", "score", "hop", "rel", "dst", F.concat_ws("|", "src", "rel", "dst").alias("edge"), F.coalesce("rel_name", "rel").alias("relation"), text.alias("text"))
    scored = edge_scores(cands, questions, bounds)
    gain = F.col("edge_score") + F.when(F.array_contains("rels", F.col("rel")), 0.0).otherwise(bounds.novelty) - bounds.hop_cost
    new = scored.select(
        "qid", F.concat_ws(";", "state", "edge").alias("state"), F.col("dst").alias("node"), F.array_append("visited", F.col("dst")).alias("visited"),
        F.array_append("rels", F.col("rel")).alias("rels"), F.round(F.col("score") + gain, 9).alias("score"), (F.col("hop") + 1).alias("hop"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "state")
    ranked = new.withColumn("nth", F.row_number().over(order))
    if own is None:
        return ranked.where(F.col("nth") <= bounds.beam).drop("nth")
    return ranked.join(own, "qid").where((F.col("nth") <= F.col("width")) & (F.col("hop") <= F.col("hops"))).select(*new.columns)


def search(seeds: DataFrame, edges: DataFrame, names: DataFrame, rel_names: DataFrame, questions: DataFrame, bounds: Bounds = Bounds(), own: DataFrame | None = None) -> DataFrame:
    """``qid, state, node, score, hop, rank``: the best distinct paths of each question, within its ``own`` limits if given.

    Every state that survives a hop is also a finished path, so a path that finds no candidate ends where it stands.
    """
    work = Workspace(seeds.sparkSession, "paths")
    beam, done = work.write(start(seeds), "beam"), None
    if own is not None:
        own = work.write(own, "limits")
    for _ in range(bounds.hops if own is None else own.agg(F.max("hops")).first()[0] or 1):
        beam = work.write(hop(beam, edges, names, rel_names, questions, bounds, own), "beam")
        done = beam if done is None else done.unionByName(beam)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "state")
    ranked = done.withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") <= bounds.paths) if own is None else ranked.join(own, "qid").where(F.col("rank") <= F.col("n_paths"))
    return kept.select("qid", "state", "node", "score", "hop", "rank")


def fair_share(paths: DataFrame, n: int | Column) -> DataFrame:
    """``n`` paths per question (a number or a column of ``paths``), first an equal share per seed (at least one), then the best of the rest.

    ``paths``: qid, seed, state, score. The shares never exceed ``n`` together.
    """
    n = F.lit(n) if isinstance(n, int) else n
    seeds = paths.groupBy("qid").agg(F.count_distinct("seed").alias("n_seeds"))
    own = Window.partitionBy("qid", "seed").orderBy(F.desc("score"), "state")
    quota = F.greatest(F.lit(1), F.floor(n / F.col("n_seeds")))
    marked = paths.join(seeds, "qid").withColumn("nth", F.row_number().over(own)).withColumn("first", F.col("nth") <= quota)
    order = Window.partitionBy("qid").orderBy(F.desc("first"), F.desc("score"), "state")
    return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("qid", "seed", "state", "score", "first", "rank")


def path_edges(paths: DataFrame, names: DataFrame, rel_names: DataFrame) -> DataFrame:
    """``qid, rank, nth, src, rel, dst, s, r, t, descr`` of every edge of every path; ``nth`` counts from 1."""
    steps = paths.select("qid", "rank", F.posexplode(F.slice(F.split("state", ";"), 2, 1000)).alias("nth", "edge")).withColumn("e", F.split("edge", r"\|"))
    steps = steps.select("qid", "rank", (F.col("nth") + 1).alias("nth"), F.col("e")[0].alias("src"), F.col("e")[1].alias("rel"), F.col("e")[2].alias("dst"))
    named = steps.join(names.select(F.col("id").alias("src"), F.col("name").alias("s")), "src").join(rel_names.select("rel", F.col("rel_name").alias("r")), "rel")
    return named.join(names.select(F.col("id").alias("dst"), F.col("name").alias("t"), "descr"), "dst")


def context(paths: DataFrame, names: DataFrame, rel_names: DataFrame) -> DataFrame:
    """``qid, context``: one citation-labelled line for every edge of every path."""
    line = F.concat(F.format_string("Path %d: [P%d.E%d] %s (%s) --%s (%s)--> %s (%s).", "rank", "rank", "nth", "s", "src", "r", "rel", "t", "dst"), F.when(F.col("descr") != "", F.concat(F.lit(" Target description: "), T.shorten(F.col("descr"), 240))).otherwise(""))
    lines = path_edges(paths, names, rel_names).select("qid", F.struct("rank", "nth", line.alias("line")).alias("x")).groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return lines.select("qid", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("context"))


def answer(paths: DataFrame, names: DataFrame, rel_names: DataFrame) -> DataFrame:
    """``qid, answer_id, answer``: the end of the best path and a sentence for each of its edges."""
    said = F.format_string("%s %s %s. [P1.E%d]", "s", "r", "t", "nth")
    steps = path_edges(paths.where("rank = 1"), names, rel_names).select("qid", F.struct("nth", "dst", said.alias("said")).alias("x")).groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return steps.select("qid", F.element_at("xs", -1)["dst"].alias("answer_id"), F.array_join(F.transform("xs", lambda x: x["said"]), " ").alias("answer"))
