import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm.packing import best_fit, pack, plan, reduce_by_dominance

SCHEMA = "doc bigint, txt string, size int, rank int, container int"


def check_plan(bins, histogram, capacity):
    used = Counter()
    for b, times in bins:
        assert times > 0 and sum(s * c for s, c in b.items()) <= capacity
        for s, c in b.items():
            used[s] += c * times
    assert used == Counter({s: n for s, n in histogram.items() if n})


def fewest(sizes, capacity):
    """The least number of containers, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, rest + [room - sizes[i]])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_never_costs_a_container(sizes):
    histogram = dict(Counter(sizes))
    fixed, rest = reduce_by_dominance(histogram, 20)
    check_plan(fixed + best_fit(rest, 20), histogram, 20)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + (fewest(left, 20) if left else 0) == (fewest(sizes, 20) if sizes else 0)


def test_large_histogram():
    rng = random.Random(3)
    histogram = {s: rng.randrange(1, 10**6) for s in rng.sample(range(1, 1025), 500)}
    bins = plan(histogram, 1024)
    check_plan(bins, histogram, 1024)
    ideal = sum(s * n for s, n in histogram.items()) / 1024
    big = sum(n for s, n in histogram.items() if s > 512)
    assert sum(t for _, t in bins) <= 1.01 * max(ideal, big) + 1 or sum(t for _, t in bins) <= 1.05 * ideal


def test_pack_rows(spark):
    rng = random.Random(4)
    texts = [" ".join("w" for _ in range(rng.randrange(1, 400))) for _ in range(200)] + ["w " * 2500, "w " * 1024, "w " * 1025, None, "", "  \n"] + ["w " * 300] * 100
    df = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in enumerate(texts)], SCHEMA)
    for buckets in (1, 7):
        rows = pack(df, "doc", "txt", buckets=buckets).collect()
        per, load = Counter(), Counter()
        for r in rows:
            per[r.item] += r.size
            load[r.container] += r.size
            assert r.piece == 1 or r.tokens > 1024
        assert per == Counter({i: len((t or "").split()) for i, t in enumerate(texts) if (t or "").split()})
        assert max(load.values()) <= 1024 and set(load) == set(range(len(load)))
        assert len(load) <= sum(load.values()) / 1024 * 1.02 + 1


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, "don't_stop, Élan 3.5 ...", 0, 0, 0)], SCHEMA)
    assert pack(df, "doc", "txt").first().tokens == 9  # don ' t_stop , Élan 3 . 5 ...
    assert pack(spark.createDataFrame([], SCHEMA), "doc", "txt").count() == 0
