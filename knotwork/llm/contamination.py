"""Evaluation texts leaking into a corpus: winnowed fingerprints joined, hits extended.

Of every ``window`` consecutive hashes of ``k`` words the least is kept. Two texts that share at least
``k + window - 1`` consecutive words share a kept hash, so no such span is missed. Fingerprints of the
corpus meet those of the test texts in one equi-join, whose small side Spark may broadcast after
measuring it; the test texts of one hash are one row, so that a common hash is one match. The pairs that meet are a table of
known size, and are extended over the full texts to their longest shared run.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.exprs import let
from knotwork.llm.text import words
from knotwork.session import Workspace

MIN_RUN = 10
K = 7


def fingerprints(text_words: Column, k: int, window: int) -> Column:
    """Distinct winnowed hashes of an array of words; empty for fewer than ``k + window - 1`` words."""
    none = F.array().cast("array<int>")

    def hashes(w: Column) -> Column:
        return F.transform(F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(none), lambda i: F.xxhash64(F.slice(w, i + 1, k)))

    def winnow(h: Column) -> Column:
        starts = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(none)
        return F.transform(starts, lambda i: F.least(*[F.get(h, i + j) for j in range(window)])) if window > 1 else h

    return F.array_distinct(let(let(F.transform(text_words, lambda x: F.xxhash64(x)), hashes), winnow))


def longest_shared_run(doc: list[str], item: list[str], k: int) -> int:
    """Most consecutive words of ``item`` that also stand consecutively in ``doc``, 0 if fewer than ``k``."""
    at = defaultdict(list)
    for j in range(len(item) - k + 1):
        at[tuple(item[j : j + k])].append(j)
    best, i = 0, 0
    ends: dict[int, int] = {}  # diagonal -> where its last extension ended in doc
    for i in range(len(doc) - k + 1):
        for j in at.get(tuple(doc[i : i + k]), ()):
            if ends.get(i - j, -1) > i:
                continue
            n = k
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            ends[i - j] = i + n - k + 1
            best = max(best, n)
    return best


def leaks(corpus: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_texts: list[str], min_run: int = MIN_RUN, k: int = K) -> DataFrame:
    """``doc, item, part, run``: every corpus text that holds at least ``min_run`` consecutive words of a test text.

    ``part`` names the column of ``item_texts``; ``run`` is the longest shared run. Words are compared ignoring case,
    and whatever stands between words. Null, empty and shorter texts on either side share nothing; repeated corpus rows
    are reported under each key; keys are assumed unique. Empty tables give an empty result.
    """
    if not 1 <= k <= min_run:
        raise ValueError("k must lie between 1 and min_run")
    window = min_run - k + 1

    @F.pandas_udf("int")
    def extend(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for docs, tests in batches:
            yield pd.Series([longest_shared_run(list(d), list(t), k) for d, t in zip(docs, tests)], dtype="int32")

    docs = corpus.select(corpus[doc_key].alias("doc"), corpus[doc_text].alias("txt")).where("txt is not null")
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), items[c].alias("txt")) for c in item_texts]))
    tests = items.select(items[item_key].alias("item"), parts.alias("p")).select("item", "p.part", words(F.col("p.txt")).alias("item_words")).where(F.size("item_words") >= min_run)
    seen = docs.select("doc", F.explode(fingerprints(words(F.col("txt")), k, window)).alias("mark"))
    marks = tests.select("item", "part", F.explode(fingerprints(F.col("item_words"), k, window)).alias("mark"))
    held = marks.groupBy("mark").agg(F.collect_list(F.struct("item", "part")).alias("held"))  # within the stated set of test texts
    met = seen.join(held, "mark").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"))
    pairs = Workspace(corpus.sparkSession, "leaks").write(met.select("doc", F.inline("held")), "pairs")
    whole = pairs.join(docs, "doc").join(tests, ["item", "part"]).withColumn("run", extend(words(F.col("txt")), F.col("item_words")))
    return whole.where(F.col("run") >= min_run).select("doc", "item", "part", "run")
