"""Audit, cleaning and comparison of the knowledge-graph tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.exprs import let
from knotwork.operators.kg import alias_list, normal

# Fixed values of the cleaning rules.
ARCHIVE_WORDS = ("archive", "archives", "help desk", "reference desk", "wikiproject", "talk page", "discussion", "template:", "category:")
NAVIGATION_PHRASES = ("may refer to", "can refer to", "refers to", "disambiguation", "list of ", "lists of ", "index of ", "outline of ", "category:", "template:", "portal:", "navigation")
WIKI_MARKS = ("[[", "]]", "{{", "}}", "<ref", "</ref>", "&nbsp;", "http://", "https://", "www.")
HUB_RELATIONS = ("P31", "P17", "P27", "P131", "P19", "P20", "P21", "P106")
ENTITY_ID, RELATION_ID = "^Q[1-9][0-9]*$", "^P[1-9][0-9]*$"
ALIAS_BUCKETS = ((0, 0), (1, 1), (2, 5), (6, 10), (11, 25), (26, 50))
LENGTH_BUCKETS = ((0, 0), (1, 20), (21, 50), (51, 100), (101, 200))
MANY_ALIASES = 50
REPETITIVE_WORDS, REPETITIVE_SHARE = 8, 0.45


def contains_any(col: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(p) for p in parts])


def bucket(value: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    """``lo-hi`` of the range that holds the value, ``>hi`` of the last beyond it."""
    out = reduce(lambda acc, r: acc.when((value >= r[0]) & (value <= r[1]), f"{r[0]}-{r[1]}"), ranges[1:], F.when((value >= ranges[0][0]) & (value <= ranges[0][1]), f"{ranges[0][0]}-{ranges[0][1]}"))
    return out.otherwise(f">{ranges[-1][1]}")


def presence(triples: DataFrame, ids: DataFrame, rels: DataFrame) -> DataFrame:
    """Triples with flags ``has_src, has_rel, has_dst``. A null id is present nowhere."""
    known = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return (
        triples.join(known.select(F.col("id").alias("src"), F.col("hit").alias("has_src")), "src", "left")
        .join(known.select(F.col("id").alias("dst"), F.col("hit").alias("has_dst")), "dst", "left")
        .join(rels.select("rel").distinct().withColumn("has_rel", F.lit(True)), "rel", "left")
        .select("triple_id", "src", "rel", "dst", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_src", "has_rel", "has_dst")])
    )


def missing_counts(flags: DataFrame) -> DataFrame:
    """``field, id, n``: how often each missing id is referred to; malformed (null) ids apart."""
    kinds = F.array(*[F.when(~F.col(f"has_{f}"), F.struct(F.lit(f).alias("field"), F.col(f).alias("id"))) for f in ("src", "rel", "dst")])
    return flags.select(F.explode(kinds).alias("m")).where("m.id is not null").groupBy("m.field", "m.id").agg(F.count(F.lit(1)).alias("n"))


def integrity(flags: DataFrame) -> DataFrame:
    """One row of counters over all triples, in one pass but for the distinct count."""
    whole = F.col("src").isNotNull() & F.col("rel").isNotNull() & F.col("dst").isNotNull()
    return flags.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~whole).alias("n_malformed"),
        F.count_if(whole & ~F.col("has_src")).alias("n_missing_src"),
        F.count_if(whole & ~F.col("has_dst")).alias("n_missing_dst"),
        F.count_if(whole & ~F.col("has_src") & ~F.col("has_dst")).alias("n_missing_both"),
        F.count_if(whole & ~F.col("has_rel")).alias("n_missing_rel"),
        F.count_if(whole & (F.col("src") == F.col("dst"))).alias("n_self_loops"),
        F.count_if(whole & F.col("has_src") & F.col("has_rel") & F.col("has_dst")).alias("n_kept"),
    )


def first_per_class(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each class in a total order; partial limits run before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= n)


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree`` over both ends of distinct triples; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def clean_aliases(ents: DataFrame) -> DataFrame:
    """``id, kept, n_blank, n_canonical, n_duplicate``: blank aliases, the name itself and later repeats dropped.

    Repeats are found on lower-case text with single blanks; the first spelling stays.
    """
    raw = F.split("aliases", r"\|")

    def first(of: Column) -> Column:
        keys = F.transform(of, normal)
        return let(keys, lambda k: F.filter(of, lambda a, i: F.array_position(k, F.get(k, i)) == i + 1))

    other = F.filter(alias_list("aliases"), lambda a: normal(a) != normal(F.col("name")))
    out = ents.select("id", "name", F.when(F.col("aliases") == "", 0).otherwise(F.size(raw)).alias("n_raw"), F.size(alias_list("aliases")).alias("n_listed"), other.alias("other"))
    return out.select("id", first(F.col("other")).alias("kept"), "n_raw", "n_listed", F.size("other").alias("n_other")).select(
        "id", "kept", (F.col("n_raw") - F.col("n_listed")).alias("n_blank"), (F.col("n_listed") - F.col("n_other")).alias("n_canonical"), (F.col("n_other") - F.size("kept")).alias("n_duplicate")
    )


def suspicious_aliases(cleaned: DataFrame) -> DataFrame:
    """``id, alias, reason``: archive-like or symbol-only aliases, or all of an entity that has very many."""
    each = cleaned.select("id", F.size("kept").alias("n"), F.explode("kept").alias("alias"))
    reason = F.when(contains_any(normal(F.col("alias")), ARCHIVE_WORDS), "archive").when(F.col("alias").rlike(r"^[^\p{L}\p{N}]+$"), "symbols").when(F.col("n") >= MANY_ALIASES, "many")
    return each.select("id", "alias", reason.alias("reason")).where("reason is not null")


def repetitive(descr: Column) -> Column:
    words = F.filter(F.split(normal(descr), " "), lambda w: w != "")
    return let(words, lambda w: (F.size(w) >= REPETITIVE_WORDS) & (F.size(F.array_distinct(w)) < REPETITIVE_SHARE * F.size(w)))


def change(a: Column, b: Column) -> Column:
    """How a text field changed between two versions."""
    return F.when(a == b, "unchanged").when(a == "", "added").when(b == "", "removed").otherwise("changed")


def compare_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """``field, change, n``: entities added, removed and common, and how each field of the common ones changed."""
    both = before.alias("a").join(after.alias("b"), F.col("a.id") == F.col("b.id"), "full_outer")
    row = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "removed").otherwise("common")
    kinds = [F.struct(F.lit("entity").alias("field"), row.alias("change"))]
    kinds += [F.struct(F.lit(f).alias("field"), F.when(row == "common", change(F.col(f"a.{f}"), F.col(f"b.{f}"))).alias("change")) for f in ("name", "aliases", "descr")]
    return both.select(F.explode(F.array(*kinds)).alias("k")).where("k.change is not null").groupBy("k.field", "k.change").agg(F.count(F.lit(1)).alias("n"))
