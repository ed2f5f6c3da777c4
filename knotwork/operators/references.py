"""References to records that are missing, deleted or not yet loaded.

The keys of the parent tables are cut into ranges of their 64-bit hash, so that all ranges have
the same expected size whatever the ids look like and no sampling pass is needed. Each range holds
its parents as arrays sorted by hash, which say in 8 bytes a key where to look, however long the ids are; the ids themselves
decide. References go to the range of their key; ranges that draw more
than ``batch_rows`` references are split by a salt, and only such ranges have their parents copied.
A batch of references (one range and salt) is probed by one vectorised binary search of its
distinct keys, and the misses are read off by index. There are as many tasks as batches.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.ids import clean_id
from knotwork.session import shuffle_partitions

MAX_RANGES = 65_536
NEVER = np.iinfo(np.int64).max


def parent_spans(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per parent key: ``ref_key`` (table name, a colon and the id), first ``loaded_at``, first ``deleted_at``.

    Times are microseconds. A parent without ``loaded_at`` never came; one without ``deleted_at`` lives for ever.
    """
    out = None
    for name, (df, id_col) in tables.items():
        part = df.select(
            F.concat(F.lit(f"{name}:"), clean_id(df[id_col])).alias("ref_key"),
            F.unix_micros(df["loaded_at"].cast("timestamp")).alias("came"),
            F.unix_micros(df["deleted_at"].cast("timestamp")).alias("gone"),
        ).where("ref_key is not null")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("ref_key").agg(
        F.coalesce(F.min("came"), F.lit(int(NEVER))).alias("came"),
        F.coalesce(F.min("gone"), F.lit(int(NEVER))).alias("gone"),
    )


def _range_of(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits).cast("int") if bits else F.lit(0)


def _locate(hashes: np.ndarray, wanted: np.ndarray, same) -> np.ndarray:
    """Position of each wanted key in the sorted ``hashes``, -1 where it is not there.

    ``same(which, at)`` tells for positions whose hashes agree whether the keys themselves do; of keys with one hash each is tried.
    """
    at = np.searchsorted(hashes, wanted)
    found = np.full(len(wanted), -1)
    open_ = np.arange(len(wanted))
    while True:
        open_ = open_[at[open_] < len(hashes)]
        open_ = open_[hashes[at[open_]] == wanted[open_]]
        if not len(open_):
            return found
        hit = same(open_, at[open_])
        found[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
        at[open_] += 1


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    refs, parents = left.combine_chunks(), right.combine_chunks()
    encoded = pc.dictionary_encode(refs["ref_key"])
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    encoded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
    index = encoded.indices.to_numpy(zero_copy_only=False)
    words = encoded.dictionary
    wanted = np.zeros(len(words), np.int64)
    wanted[index] = refs["ref_hash"].to_numpy()
    order = np.argsort(parents["ref_hash"].to_numpy(), kind="stable")
    keys = parents["ref_key"]
    same = lambda which, at: pc.equal(words.take(pa.array(which)), keys.take(pa.array(order[at]))).to_numpy(zero_copy_only=False)
    found = _locate(parents["ref_hash"].to_numpy()[order], wanted, same)
    known = found >= 0
    spot = order[found[known]]
    since, until = np.full(len(wanted), NEVER), np.full(len(wanted), NEVER)
    since[known], until[known] = parents["came"].to_numpy()[spot], parents["gone"].to_numpy()[spot]
    moment = refs["ref_at"].to_numpy()
    miss = (since[index] > moment) | (until[index] <= moment)
    absent = since[index] == NEVER
    kept = pa.array(np.flatnonzero(miss))
    reason = np.where(absent, 0, np.where(since[index] > moment, 1, 2)).astype(np.int32)
    return pa.table({"row_id": refs["row_id"].take(kept), "field": refs["field"].take(kept), "ref_at": refs["ref_at"].take(kept), "reason": pa.array(reason).take(kept)})


def orphan_references(
    child: DataFrame,
    row_id: str,
    at: str,
    fields: Mapping[str, str],
    parents: Mapping[str, tuple[DataFrame, str]],
    batch_rows: int = 400_000,
    parents_per_range: int = 50_000,
) -> DataFrame:
    """Every reference of ``child`` that points to no live parent at the row's ``at``.

    ``fields`` maps a column of ``child`` to a name in ``parents``, which maps it to (table, id column) with
    ``loaded_at`` and ``deleted_at``. Result: ``row_id`` (bigint), ``field_name``, ``table_name``, ``ref_at``
    (timestamp) and ``reason``: ``missing`` (no such record ever came), ``late`` (it came after ``at``) or
    ``deleted`` (it was deleted at or before ``at``).

    Null and blank ids are no references. A null ``at`` counts as the end of time: such a reference is reported if
    its parent never came or was ever deleted. Repeated child rows are reported once each; empty tables give an
    empty result, or all references as ``missing`` where only the parents are empty. Other columns are ignored.
    """
    spark = child.sparkSession
    spans = parent_spans(parents)
    n_rows = child.count()
    n_parents = sum(df.count() for df, _ in parents.values())
    wish = max(shuffle_partitions(spark), n_parents // parents_per_range, 3 * n_rows // batch_rows, 1)
    bits = int(np.ceil(np.log2(min(wish, MAX_RANGES))))
    names = list(fields)
    moment = F.coalesce(F.unix_micros(child[at].cast("timestamp")), F.lit(int(NEVER) - 1))
    refs = (
        child.select(
            child[row_id].cast("bigint").alias("row_id"),
            moment.alias("ref_at"),
            F.explode(
                F.array(*[F.struct(F.lit(i).alias("field"), F.concat(F.lit(f"{fields[f]}:"), clean_id(child[f])).alias("ref_key")) for i, f in enumerate(names)])
            ).alias("r"),
        )
        .select("row_id", "ref_at", "r.field", "r.ref_key")
        .where("ref_key is not null")
        .withColumn("ref_hash", F.xxhash64("ref_key"))
        .withColumn("range", _range_of(F.col("ref_hash"), bits))
    )
    # At most MAX_RANGES rows of (int, int): a bounded broadcast. Ranges that need no salt are left out.
    hot = (
        child.select(F.explode(F.array(*[F.concat(F.lit(f"{fields[f]}:"), clean_id(child[f])) for f in names])).alias("ref_key"))
        .where("ref_key is not null")
        .groupBy("ref_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(_range_of(F.xxhash64("ref_key"), bits).alias("range"))
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > batch_rows)
        .select("range", F.ceil(F.col("n") / batch_rows).cast("int").alias("salts"))
    )
    hot = F.broadcast(hot)
    salted = (
        refs.join(hot, "range", "left")
        .withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.hash("row_id", "field"), F.col("salts"))))
        .select("range", "salt", "row_id", "field", "ref_at", "ref_key", "ref_hash")
    )
    held = (
        spans.withColumn("ref_hash", F.xxhash64("ref_key"))
        .withColumn("range", _range_of(F.col("ref_hash"), bits))
        .join(hot, "range", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
        .select("range", "salt", "ref_key", "ref_hash", "came", "gone")
    )
    # Batches meet their parents in tasks of a fixed size: their number grows with the references.
    tasks = max(shuffle_partitions(spark), 1 + 3 * n_rows // batch_rows)
    salted, held = salted.repartition(tasks, "range", "salt"), held.repartition(tasks, "range", "salt")
    misses = salted.groupBy("range", "salt").cogroup(held.groupBy("range", "salt")).applyInArrow(_probe, "row_id bigint, field int, ref_at bigint, reason int")
    return misses.select(
        "row_id",
        F.element_at(F.array(*map(F.lit, names)), F.col("field") + 1).alias("field_name"),
        F.element_at(F.array(*[F.lit(fields[f]) for f in names]), F.col("field") + 1).alias("table_name"),
        F.when(F.col("ref_at") < int(NEVER) - 1, F.timestamp_micros("ref_at")).alias("ref_at"),
        F.element_at(F.array(*map(F.lit, ("missing", "late", "deleted"))), F.col("reason") + 1).alias("reason"),
    )


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Misses per referenced table, month and reason; the month is null where the row has no time."""
    return orphans.groupBy("table_name", F.date_format("ref_at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_references"))


