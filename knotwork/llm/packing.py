"""Filling containers of fixed capacity with texts measured in tokens.

Sizes are whole numbers up to the capacity, so an instance is its histogram: at most ``capacity``
pairs (size, count), however many texts there are. The plan is made on that histogram: Martello-Toth
dominance fixes sets that no other set with the same item can beat, for all copies at once;
best-fit decreasing places the rest, also in bulk. The plan comes back as intervals of ranks within each size
(their number is bounded by the capacity as well), and the texts find their container by
size and rank, which is computed in parallel from hashed buckets, never in one window over a hot size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.text import n_tokens
from knotwork.session import Workspace, shuffle_partitions

CAPACITY = 1024


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """Fixed containers as (sizes, how many) and the histogram that is left.

    For each size j, from the largest down, with k the largest size that fits beside it: {j} is fixed if nothing fits; {j, k} if k
    fills the container exactly or no two items fit beside j; {j, k} also if k is at least the largest sum of two items
    that fit while no three do; and {j, k, b} if no three fit, it fills the container exactly and every other pair that
    fits has its smaller item within b or its sum within k.
    Sizes for which no rule holds stay in the pool, for others to join; the passes end when one fixes nothing. Every
    fixing uses up a size or leaves one copy of it, so there are few more than ``capacity`` of them.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[Counter, int]] = []

    def take(bin_: Counter) -> None:
        times = min(left[s] // c for s, c in bin_.items())
        if times:
            fixed.append((bin_, times))
            for s, c in bin_.items():
                left[s] -= times * c
                if not left[s]:
                    del left[s]
                    sizes.remove(s)

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(left[s] - (s == without), n - len(out))
            if len(out) >= n:
                break
        return out

    def best_pair(room: int, j: int) -> tuple[int, int, int]:
        best = (0, 0, 0)
        for b in sizes:
            if 2 * b > room:
                break
            own_b = left[b] - (b == j)
            if own_b < 1:
                continue
            at = bisect_right(sizes, room - b) - 1
            while at >= 0:
                a = sizes[at]
                if left[a] - (a == j) - (a == b) >= 1:
                    best = max(best, (a + b, a, b))
                    break
                at -= 1
        return best

    def rival(room: int, j: int, k: int, b: int) -> bool:
        """Whether some pair x >= y > b beside j fits with a sum above k."""
        for y in sizes[bisect_right(sizes, b) : bisect_right(sizes, room // 2)]:
            if left[y] - (y == j) < 1:
                continue
            for x in sizes[bisect_left(sizes, max(y, k - y + 1)) : bisect_right(sizes, room - y)]:
                if left[x] - (x == j) - (x == y) >= 1:
                    return True
        return False

    def dominating(j: int) -> Counter | None:
        """A set with j that no other set with j can beat, if one of the rules gives it."""
        room = capacity - j
        at = bisect_right(sizes, room) - 1
        while at >= 0 and left[sizes[at]] - (sizes[at] == j) < 1:
            at -= 1
        if at < 0:
            return Counter([j])
        k = sizes[at]
        two = smallest(2, j)
        if k == room or len(two) < 2 or sum(two) > room:
            return Counter([j, k])
        three = smallest(3, j)
        if len(three) < 3 or sum(three) > room:
            total, a, b = best_pair(room, j)
            if k >= total:
                return Counter([j, k])
            if total == room and a == k and not rival(room, j, k, b):
                return Counter([j, a, b])
        return None

    reduced = True
    while reduced:
        reduced = False
        for j in sorted(left, reverse=True):
            while j in left and (bin_ := dominating(j)) is not None:
                take(bin_)
                reduced = True
    return fixed, left


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on a histogram: open containers are kept by their room, equal ones together."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[Counter, int]]] = {}

    def put(room: int, bin_: Counter, times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((bin_, times))

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, n)
                whole = n // each
                put(capacity - each * size, Counter({size: each}), whole)
                n -= whole * each
                continue
            room = rooms[at]
            bin_, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.remove(room)
            each = min(room // size, n)
            used = min(times, n // each)
            put(room - each * size, bin_ + Counter({size: each}), used)
            if used < times:
                put(room, bin_, times - used)
            n -= used * each
    return [entry for bins in open_.values() for entry in bins]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    fixed, rest = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def sized(df: DataFrame, key: str, field: str) -> DataFrame:
    return df.select(df[key].alias("item"), n_tokens(df[field]).cast("bigint").alias("tokens"))


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """``item, tokens, piece, size``: whole containers for what exceeds the capacity, then the remainder."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    return items.where("tokens > 0").select("item", "tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("piece")).select(
        "item", "tokens", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("tokens") - (F.col("piece") - 1) * capacity).cast("int").alias("size")
    )


def pack(df: DataFrame, key: str, field: str, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """One row per text or piece: ``item, tokens, piece`` (from 1), ``size`` and ``container`` (bigint from 0).

    Only texts above the capacity are split, into full pieces and one remainder. Null texts and texts without a token
    take no room and get no row. Keys must be unique; equal sizes are ranked by bucket and key, so the result does not
    depend on how the input is cut. Very long texts give as many pieces as needed; an empty table gives no rows.
    """
    spark = df.sparkSession
    # Tokens are counted once; the plan and the placement read the sizes.
    parts = pieces_of(Workspace(spark, "packing").write(sized(df, key, field), "sizes"), capacity)
    buckets = buckets or max(1, min(4096, shuffle_partitions(spark)))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).cast("int"))
    # The offsets of each bucket's ranks, and the histogram for the plan, of at most ``capacity`` rows.
    cells = parts.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    taken: Counter = Counter()
    intervals, first = [], 0
    for bin_, times in plan(histogram, capacity):
        for size, each in sorted(bin_.items()):
            intervals.append((size, taken[size], taken[size] + each * times, each, first))
            taken[size] += each * times
        first += times
    table = spark.createDataFrame(intervals, "size int, start bigint, stop bigint, each bigint, first bigint")
    slots = F.broadcast(table.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "each", "first"))).alias("slots")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select("size", "bucket", before.alias("offset"))
    local = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("item", "piece")) - 1
    ranked = parts.withColumn("local", local).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("offset") + F.col("local"))
    placed = ranked.join(slots, "size").withColumn("slot", F.get(F.filter("slots", lambda s: (s["start"] <= F.col("rank")) & (F.col("rank") < s["stop"])), F.lit(0)))
    return placed.select(
        "item", "tokens", "piece", "size", (F.col("slot.first") + F.floor((F.col("rank") - F.col("slot.start")) / F.col("slot.each"))).cast("bigint").alias("container")
    )
