import random

import pytest

from knotwork.llm.contamination import leaks, longest_shared_run
from knotwork.llm.text import words
from pyspark.sql import functions as F

DOCS, ITEMS = "doc_id bigint, text string, item bigint, part string", "item_id bigint, question string, passage string, doc bigint"


def brute(docs, items, least):
    out = set()
    for d, text in docs:
        w = (text or "").lower().replace(",", " ").split()
        for i, *parts in items:
            for name, p in zip(("question", "passage"), parts):
                v = (p or "").lower().replace(",", " ").split()
                grams = {tuple(v[j : j + least]) for j in range(len(v) - least + 1)}
                if any(tuple(w[j : j + least]) in grams for j in range(len(w) - least + 1)):
                    out.add((d, i, name))
    return out


@pytest.mark.parametrize("k", [4, 7, 10])
def test_every_long_span_is_found(spark, k):
    rng = random.Random(k)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(5, 25))), rng.choice([None, "", " ".join(rng.choice(pool) for _ in range(18))])) for i in range(25)]
    docs = []
    for d in range(150):
        w = [rng.choice(pool) for _ in range(rng.randrange(40))]
        source = rng.choice(items)[1].split()
        n = rng.randrange(4, 14)
        at = rng.randrange(max(1, len(source) - n))
        w[len(w) // 2 : len(w) // 2] = source[at : at + n]
        docs.append((d, ", ".join(w).upper() if d % 2 else " ".join(w)))
    docs += [(900, None), (901, ""), (902, docs[3][1])]
    got = leaks(spark.createDataFrame([(*x, 1, "p") for x in docs], DOCS), "doc_id", "text", spark.createDataFrame([(*x, 1) for x in items], ITEMS), "item_id", ["question", "passage"], k=k).collect()
    assert {(r.doc, r.item, r.part) for r in got} == brute(docs, items, 10)
    assert len(got) == len({(r.doc, r.item, r.part) for r in got}) and all(r.run >= 10 for r in got)


def test_longest_run():
    assert longest_shared_run("a b c d e f".split(), "x b c d e y".split(), 2) == 4
    assert longest_shared_run("a a a a a".split(), "a a a".split(), 2) == 3
    assert longest_shared_run([], ["a"], 1) == 0


def test_empty_and_words(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaks(docs, "doc_id", "text", items, "item_id", ["question"]).count() == 0
    assert spark.range(1).select(words(F.lit("Don't_STOP, Élan3")).alias("w")).first().w == ["don", "t", "stop", "élan3"]
