"""Entity linking of questions: mentions in order, lexical and dense evidence, robust mentions and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions import text as T
from knotwork.operators.seeds import lexicon

# Fixed values of the robust rules: openings of questions, words that no entity is named by, words about relations, words at the edge of a mention.
PREFIXES = (
    "how many of the ", "how many of ", "how many ", "how much of the ", "how much of ", "how much ", "who were the ", "who was the ", "who are the ", "who is the ",
    "what were the ", "what was the ", "what are the ", "what is the ", "what is a ", "what is an ", "what is ", "what are ", "when is the ", "when is ", "when was the ", "when was ",
    "who is ", "who was ", "tell me about the ", "tell me about ", "where is the ", "where is ", "list all of the ", "list all the ", "list all ", "list the ", "name all of the ", "name all the ", "name all ",
)
QUESTION_STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from "
    "further had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves "
    "out over own same shan't she should shouldn't so some such than that the their theirs them themselves then there these they this those through to too under until up very was wasn't we were weren't what when where which while who "
    "whom why with won't would wouldn't you your yours yourself yourselves tell show find give name list present many much total count number amount several"
).split()
QUERY_TERMS = (
    "direct directed director directing made make makes manufacturer manufactured found founder founded capital located location country countries film movie book company produced producer created creator wrote write written state states "
    "border borders bordering boundary boundaries share shares shared member members child children city headquarters headquarter building architectural style situated coordinates institution academic discoverer inventor graduate graduated "
    "river birthplace island continent official language filmed developer currency airline hub operating system systems actor played console designed president"
).split()
DANGLING = "of the in to for at from where which that with is was are were did does by a an as on".split()
COMPLEMENT = (" of ", " in ", " by ", " at ", " for ")
ROBUST_MEDIA = ("album", "studio album", "single by", "song by", "track by", "film", "movie")
ROBUST_OPENINGS = ("what is a ", "what is an ", "what is ", "what are ")
_FILTER = tuple(dict.fromkeys((*QUESTION_STOP_WORDS, *QUERY_TERMS, *DANGLING)))
_WORD = r"[a-z0-9]+(?:'[a-z0-9]+)?"


def _bare(question: Column) -> Column:
    """Lower case, one opening and closing marks taken off, straight apostrophes."""
    q = F.trim(F.lower(F.replace(question, F.lit("’"), F.lit("'"))))
    opened = F.coalesce(*[F.when(q.startswith(p), F.trim(F.substring(q, F.lit(len(p) + 1), F.length(q)))) for p in PREFIXES], q)
    return F.trim(F.regexp_replace(opened, r"[?.!]+$", ""))


def possessive_variants(mention: Column) -> Column:
    """The mention and, where it has one, the mention without its possessive ending."""
    return F.array_distinct(F.array(mention, F.regexp_replace(mention, "'s\\b", "")))


def robust_mentions(question: Column) -> Column:
    """Distinct lower-case candidates: complements behind prepositions, n-grams of content words, n-grams with pruned edges.

    Candidates with more content words come first, then longer ones, then by their letters; a candidate needs two characters and
    a word that is no stop word, term of a relation or dangling word.
    """
    bare = _bare(question)
    words = F.regexp_extract_all(bare, F.lit(_WORD), F.lit(0))
    content = F.filter(words, lambda w: ~w.isin(*QUESTION_STOP_WORDS, *QUERY_TERMS) & (F.length(w) >= 2))
    pruned = F.transform(T.ngrams(words, 5), lambda g: F.trim(F.regexp_replace(g, rf"^(?:(?:{'|'.join(DANGLING)}) )+|(?: (?:{'|'.join(DANGLING)}))+$|^(?:{'|'.join(DANGLING)})$", "")))
    kept = F.filter(pruned, lambda g: F.exists(F.split(g, " "), lambda w: (w != "") & ~w.isin(*QUESTION_STOP_WORDS, *QUERY_TERMS)))
    none = F.array().cast("array<string>")
    after = [F.when(bare.contains(m), F.slice(F.split(bare, m), F.lit(2), F.greatest(F.lit(1), F.size(F.split(bare, m)) - 1))).otherwise(none) for m in COMPLEMENT]
    ends = F.transform(F.concat(*after), lambda p: F.array_join(F.filter(F.split(F.regexp_replace(F.trim(p), r"^(?:the|an?)\s+", ""), r"\s+"), lambda w: (w != "") & ~w.isin(*DANGLING)), " "))
    every = F.array_distinct(F.filter(F.concat(ends, T.ngrams(content, 4), kept), lambda m: (F.length(m) >= 2) & ~m.isin(*_FILTER)))
    salience = F.transform(every, lambda m: F.struct((-F.size(F.filter(F.split(m, " "), lambda w: ~w.isin(*_FILTER)))).alias("n"), (-F.length(m)).alias("l"), m.alias("m")))
    return F.transform(F.array_sort(salience), lambda s: s["m"])


def degree_prior(degree: Column) -> Column:
    return F.when(degree > 0, F.least(F.lit(0.25), 0.04 * F.log(degree + 1))).otherwise(0.0)


def robust_scores(questions: DataFrame, ents: DataFrame, members: DataFrame, scope: DataFrame, degrees: DataFrame, least: float = 0.35) -> DataFrame:
    """``qid, id, term, pid, confidence``: the best mention of every entity by the robust rules.

    1 for the match, 0.1 per word up to 0.3, 0.6 in scope (``scope``: qid, pid), the degree prior, 0.08 per content word that
    question and description share up to 0.3, words of the description / 500 up to 0.15, and 0.25 off for entertainment
    records in definitional questions. Ties go to the longer, then the smaller mention.
    """
    asked = questions.select("qid", "question", F.explode(robust_mentions(F.col("question"))).alias("term"))
    met = asked.join(lexicon(ents), "term").join(ents.select("id", "descr"), "id").join(members, "id", "left").join(scope.distinct().withColumn("inside", F.lit(True)), ["qid", "pid"], "left").join(degrees, "id", "left")
    q, d = F.lower("question"), F.lower("descr")
    shared = F.size(F.array_intersect(F.array_distinct(T.content_tokens(F.col("question"))), F.array_distinct(T.ascii_tokens(F.col("descr")))))
    opens = F.lit(False)
    for start in ROBUST_OPENINGS:
        opens = opens | q.startswith(start)
    n_words = F.size(F.filter(F.split("descr", r"\s+"), lambda w: w != ""))
    confidence = (
        1.0 + F.least(F.lit(0.3), 0.1 * F.size(F.split("term", " "))) + F.when(F.col("inside"), 0.6).otherwise(0.0) + degree_prior(F.coalesce("degree", F.lit(0)))
        + F.least(F.lit(0.3), 0.08 * shared) + F.least(F.lit(0.15), n_words / 500.0) - F.when(opens & T.any_of(d, ROBUST_MEDIA), 0.25).otherwise(0.0)
    )
    scored = met.select("qid", "id", "term", "pid", F.round(confidence, 9).alias("confidence")).where(F.col("confidence") >= least)
    best = Window.partitionBy("qid", "id").orderBy(F.desc("confidence"), F.desc(F.length("term")), "term")
    return scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def robust_selection(scored: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` best seeds of each question, however many share a mention."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("confidence"), "id"))).where(F.col("rank") <= most)


def mention_order(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, id, score, earliest, latest`` of ``asked`` (qid, nth, term) and ``names`` (id, term): positions of the best-scored mentions."""
    score = F.least(F.lit(0.3), 0.1 * F.size(F.split("term", " ")))
    met = asked.join(names, "term").select("qid", "id", "nth", score.alias("s"))
    top = met.groupBy("qid", "id").agg(F.max("s").alias("score"))
    return met.join(top, ["qid", "id"]).where("s = score").groupBy("qid", "id").agg(F.max("score").alias("score"), F.min("nth").alias("earliest"), F.max("nth").alias("latest"))


def hybrid_links(lexical: DataFrame, dense: DataFrame, weight: float = 0.7, k: int = 5) -> DataFrame:
    """``qid, id, score, rank`` from ``lexical`` (qid, id, n_words) and ``dense`` (qid, id, sim; the best of each question).

    ``weight`` of the words of the mention over the most words of any of the question's, plus the rest of the dense score scaled to
    [0, 1]; candidates of either side count. A single dense candidate counts as its score itself.
    """
    lex = lexical.join(lexical.groupBy("qid").agg(F.max("n_words").alias("most")), "qid").select("qid", "id", (F.col("n_words") / F.greatest("most", F.lit(1))).alias("l"))
    span = dense.groupBy("qid").agg(F.min("sim").alias("low"), F.max("sim").alias("high"), F.count(F.lit(1)).alias("n"))
    scaled = F.when(F.col("n") > 1, (F.col("sim") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9)).otherwise(F.col("sim"))
    den = dense.join(span, "qid").select("qid", "id", scaled.alias("d"))
    both = lex.join(den, ["qid", "id"], "full_outer").select("qid", "id", F.round(weight * F.coalesce("l", F.lit(0.0)) + (1 - weight) * F.coalesce("d", F.lit(0.0)), 9).alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def link_metrics(ranked: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """Per question of ``gold`` (qid, id): ``recall`` and ``precision`` at k, ``hit_1`` and ``mrr`` of ``ranked`` (qid, id, rank)."""
    n_pred = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.count(F.lit(1)).alias("n_pred"))
    met = gold.select("qid", "id").distinct().join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    per = met.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first")).join(n_pred, "qid", "left")
    return per.select(
        "qid", "n_gold", F.round(F.col("found") / F.col("n_gold"), 6).alias("recall"), F.round(F.coalesce(F.try_divide("found", "n_pred"), F.lit(0.0)), 6).alias("precision"),
        F.coalesce((F.col("first") == 1).cast("int"), F.lit(0)).alias("hit_1"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )
