"""Repetition inside a text, judged by weak supervision.

Six rules each look at a text and vote *repetitive*, *fine* or abstain. One of them is the exact measure, the share of
words inside a repeated run of ``run`` words; it is the definition, so its trust is given. How far the others are to be
trusted is not set by hand: expectation-maximisation over the counts of vote patterns (at most 3^6 of
them, whatever the number of texts) estimates for each rule how it votes on repetitive and on fine
texts, and every pattern gets its posterior probability of repetition, which says what text is to be left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.exprs import let
from knotwork.llm.text import words
from knotwork.session import Workspace

#: rule: (feature, votes "repetitive" from here on, votes "fine" up to here); it abstains between.
RULES = {
    "run_starts": ("f_runs", 1 / 6, 0.0),
    "pairs": ("f_pairs", 0.3, 0.05),
    "vocabulary": ("f_words", 0.45, 0.15),
    "sentences": ("f_sentences", 0.25, 0.0),
    "top_word": ("f_top", 0.25, 0.12),
    "share": ("repeated_share", 0.5, 0.25),
}
#: Given trust of the exact rule: how it votes (abstains, fine, repetitive) on fine and on repetitive texts.
GIVEN = {"share": ((0.01, 0.9899, 0.0001), (0.01, 0.01, 0.98))}


def _grams(w: Column, k: int) -> Column:
    n = F.size(w)
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))


def _repeats(items: Column) -> Column:
    n = F.size(items)
    return F.when(n > 0, (n - F.size(F.array_distinct(items))) / n).otherwise(0.0)


def _counts(w: Column, txt: Column, run: int) -> Column:
    n = F.size(w)
    start = F.struct(F.lit("").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("m"))
    same = lambda acc, x: F.struct(x.alias("v"), (acc["n"] + 1).alias("n"), F.greatest(acc["m"], acc["n"] + 1).alias("m"))
    other = lambda acc, x: F.struct(x.alias("v"), F.lit(1).alias("n"), F.greatest(acc["m"], F.lit(1)).alias("m"))
    longest = F.aggregate(F.array_sort(w), start, lambda acc, x: F.when(acc["v"] == x, same(acc, x)).otherwise(other(acc, x)), lambda acc: acc["m"])
    sentences = F.filter(F.transform(F.split(txt, r"[.!?;\n]+"), lambda s: F.array_join(words(s), " ")), lambda s: F.length(s) > 0)
    return F.struct(
        w.alias("w"),
        let(_grams(w, run), _repeats).alias("f_runs"),
        let(_grams(w, 2), _repeats).alias("f_pairs"),
        _repeats(w).alias("f_words"),
        let(sentences, _repeats).alias("f_sentences"),
        F.when(n > 0, longest / n).otherwise(0.0).alias("f_top"),
    )


def features(df: DataFrame, key: str, field: str, run: int = 3) -> DataFrame:
    """``key, n_words`` and one number in [0, 1] per rule, from hash-based distinct counts inside the row.

    The words of a text go to the exact measure only where some run of words comes twice; elsewhere its share is 0.
    """

    @F.pandas_udf("double")
    def share(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([0.0 if w is None or not len(w) else repeated_words(list(w), run) / len(w) for w in batch], dtype="float64")

    w = F.coalesce(words(df[field]), F.array().cast("array<string>"))
    txt = F.coalesce(df[field], F.lit(""))
    counted = df.select(df[key].alias(key), F.inline(F.array(let(w, lambda v: _counts(v, txt, run)))))
    measured = counted.withColumn("repeated_share", share(F.when(F.col("f_runs") > 0, F.col("w"))))
    return measured.withColumn("n_words", F.size("w").cast("bigint")).drop("w")


def votes(feats: DataFrame) -> DataFrame:
    """Adds ``v_<rule>``: 1 repetitive, 0 fine, -1 abstains."""
    cols = {}
    for rule, (feature, yes, no) in RULES.items():
        cols[f"v_{rule}"] = F.when(F.col(feature) >= yes, 1).when(F.col(feature) <= no, 0).otherwise(-1)
    return feats.withColumns(cols)


def fit_em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, given: Mapping[int, tuple] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, the vote tables ``P(vote | class)`` (rule, class, vote + 1) and the prior.

    The start believes every rule to be right in 80 % of its votes; votes are smoothed by one count. Tables of the rules
    in ``given`` (position: table) stay as they are.
    """
    n_rules = patterns.shape[1]
    table = np.empty((n_rules, 2, 3))
    table[:, 1] = [0.2, 0.16, 0.64]
    table[:, 0] = [0.2, 0.64, 0.16]
    for r, fixed in (given or {}).items():
        table[r] = fixed
    prior = 0.1
    total = counts.sum()
    posterior = np.zeros(len(patterns))
    for _ in range(rounds if total else 0):
        log_odds = np.log(prior) - np.log1p(-prior) + sum(np.log(table[r, 1, patterns[:, r] + 1]) - np.log(table[r, 0, patterns[:, r] + 1]) for r in range(n_rules))
        posterior = 1 / (1 + np.exp(-log_odds))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = float(np.clip(weight[1].sum() / total, 1e-6, 1 - 1e-6))
        for r in set(range(n_rules)) - set(given or ()):
            for vote in range(3):
                table[r, :, vote] = 1 + weight[:, patterns[:, r] == vote - 1].sum(axis=1)
            table[r] /= table[r].sum(axis=1, keepdims=True)
    return posterior, table, prior


def posteriors(voted: DataFrame) -> DataFrame:
    """One row per vote pattern: the votes, ``n`` texts and ``posterior``. At most 3^6 rows reach the driver."""
    names = [f"v_{r}" for r in RULES]
    rows = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort()
    patterns = np.array([[r[c] for c in names] for r in rows], dtype=int).reshape(len(rows), len(names))
    posterior, _, _ = fit_em(patterns, np.array([r["n"] for r in rows], dtype=float), given={list(RULES).index(r): t for r, t in GIVEN.items()})
    data = [(*map(int, p), int(r["n"]), float(q)) for p, r, q in zip(patterns, rows, posterior)]
    return voted.sparkSession.createDataFrame(data, ", ".join(f"{c} int" for c in names) + ", n bigint, posterior double")


def repeated_words(w: list[str], run: int = 3) -> int:
    """Words inside a run of ``run`` consecutive words that already began earlier in the list."""
    seen: set[tuple[str, ...]] = set()
    covered, upto = 0, 0
    for i in range(len(w) - run + 1):
        gram = tuple(w[i : i + run])
        if gram in seen:
            covered += i + run - max(i, upto)
            upto = i + run
        else:
            seen.add(gram)
    return covered


def repetition(df: DataFrame, key: str, field: str, run: int = 3) -> DataFrame:
    """One row per input row: ``key, n_words, repeated_share, posterior``.

    ``repeated_share`` is the exact share of words inside repeated runs, ``posterior`` the probability that the text is
    repetitive, given the votes of all rules. Null, blank and short texts have no repeated words. Repeated rows are judged alike;
    the words of very long texts are measured whole. Empty tables give an empty result; other columns are ignored.
    Texts are read once; what the rules saw is a table in the shared folder.
    """
    work = Workspace(df.sparkSession, "repetition")
    rules = [f"v_{r}" for r in RULES]
    voted = work.write(votes(features(df, key, field, run)).select(key, "n_words", "repeated_share", *rules), "votes")
    known = F.broadcast(posteriors(voted).drop("n"))  # at most 3^6 rows
    return voted.join(known, rules, "left").select(key, "n_words", "repeated_share", "posterior")
