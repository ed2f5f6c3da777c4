import random

import numpy as np

from knotwork.llm.repetition import fit_em, posteriors, repeated_words, repetition, features, votes

SCHEMA = "rec bigint, descr string, w int, posterior double"


def brute(words, run=3):
    hit = set()
    for i in range(len(words) - run + 1):
        if any(words[j : j + run] == words[i : i + run] for j in range(i)):
            hit |= set(range(i, i + run))
    return len(hit)


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.choice("abc") for _ in range(rng.randrange(14))]
        assert repeated_words(w) == brute(w)


def corpus():
    rng = random.Random(2)
    vocabulary = [f"wort{i}" for i in range(400)]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 60))) for _ in range(300)]
    loops = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))) + rng.choice([". ", ", ", " "])) * rng.randrange(2, 8) for _ in range(60)]
    part = [" ".join(rng.choice(vocabulary) for _ in range(20)) + " " + "again and again it goes " * rng.randrange(1, 9) for _ in range(40)]
    return plain + loops + part + [None, "", "   ", "a b", "very " * 30, "Ä ä, Ä! ä Ä ä ä-ä Ä ä"]


def test_operator_finds_all_that_the_exact_measure_finds(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.rec: r for r in repetition(df, "rec", "descr").collect()}
    assert set(rows) == set(range(len(texts)))
    import re

    for i, text in enumerate(texts):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        share = brute(w) / len(w) if w else 0.0
        assert rows[i].n_words == len(w)
        assert abs(rows[i].repeated_share - share) < 1e-9
        if len(w) >= 8 and share >= 0.5:
            assert rows[i].posterior >= 0.5


def test_em_orders_patterns():
    patterns = np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 0], [1, 1, 1, -1, 0], [-1, 0, 0, 0, 0]])
    posterior, table, prior = fit_em(patterns, np.array([20.0, 900.0, 10.0, 70.0]))
    assert posterior[0] > 0.9 and posterior[2] > 0.5 and posterior[1] < 0.01 and 0.01 < prior < 0.1
    assert np.allclose(table.sum(axis=2), 1)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repetition(df, "rec", "descr").count() == 0
    assert posteriors(votes(features(df, "rec", "descr"))).count() == 0


def test_posterior_keeps_every_case_in_any_mix(spark):
    plain, loops = corpus()[:300], ["very " * 30, "one two three four " * 2, "it goes on and on. " * 9]
    for texts in (loops, loops + plain[:3], loops[:1] + plain, loops * 40 + plain[:20]):
        df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in enumerate(texts)], SCHEMA)
        for r in repetition(df, "rec", "descr").collect():
            assert (r.posterior >= 0.5) == (r.repeated_share >= 0.5)
