"""Vectors: hashed encodings, means, products in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import Workspace

DIMS = 64


def hash_coordinates(tokens: DataFrame, key: str, token: str, dims: int = DIMS) -> DataFrame:
    """``key, dim, val``: signed counts of tokens hashed to ``dims`` coordinates, scaled to unit length.

    The coordinate is the number of the first eight hexadecimal digits of the token's MD5 modulo ``dims``; the ninth
    digit gives the sign. Keys without tokens, or whose counts cancel out, have no coordinates.
    """
    digest = F.md5(F.col(token))
    dim = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dims).cast("int")
    sign = F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0)
    sums = tokens.select(key, dim.alias("dim"), sign.alias("s")).groupBy(key, "dim").agg(F.sum("s").alias("v")).where("v <> 0")
    return sums.withColumn("val", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))).select(key, "dim", "val")


def dense(coordinates: DataFrame, key: str, dims: int = DIMS) -> DataFrame:
    """``key, vec``: coordinates as arrays. At most ``dims`` pairs meet per key."""
    held = F.map_from_entries(F.collect_list(F.struct("dim", "val")))
    return coordinates.groupBy(key).agg(held.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0.0))).alias("vec"))


def unit(vec: Column) -> Column:
    """A numeric array scaled to unit length in double precision; null where the length is zero."""
    v = vec.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def mean_coordinates(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, dim, mean, n``: element-wise mean per group, combined on the map side."""
    flat = df.where(F.col(group).isNotNull()).select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    return flat.groupBy(group, "dim").agg(F.avg("x").alias("mean"), F.count("x").alias("n"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cell(left: pa.Table, right: pa.Table, keep: int | None, axis: int, decimals: int) -> pa.Table:
    """Scores of all queries of a block against all rows of a block; with ``keep`` the best along ``axis`` with all ties of the last place."""
    names = {"qid": left.schema.field("qid").type, "id": right.schema.field("id").type, "score": pa.float64()}
    if not left.num_rows or not right.num_rows:
        return pa.schema(names.items()).empty_table()
    scores = np.round(_matrix(left["vec"]) @ _matrix(right["vec"]).T, decimals)
    length = scores.shape[axis]
    if keep and keep < length:
        floor = np.partition(scores, length - keep, axis=axis).take(length - keep, axis=axis)
        at, col = np.nonzero(scores >= np.expand_dims(floor, axis))
    else:
        at, col = (x.ravel() for x in np.indices(scores.shape))
    return pa.table({"qid": left["qid"].take(pa.array(at)), "id": right["id"].take(pa.array(col)), "score": pa.array(scores[at, col])})


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def products(queries: DataFrame, corpus: DataFrame, block: int = 2048, keep: int | None = None, of: str = "query", decimals: int = 9, rows: int = 8192) -> DataFrame:
    """``qid, id, score`` of every query against the whole corpus; with ``keep`` only the best, adding ``rank``.

    ``queries`` has ``qid, vec`` and ``corpus`` ``id, vec``; keys are unique and of any type, null vectors take no part. ``of="query"``
    keeps the best rows of each query, ``of="row"`` the best queries of each row; ties go to the smaller key. If one side
    has at most ``block`` vectors, which is counted, it goes to every task and the other side is read in one pass.
    Otherwise both sides are cut by hash into blocks of some ``block`` and ``rows`` vectors, every pair of blocks is one matrix product
    in one task, and each task cuts its own lists before they are merged. No vector passes through the driver then.
    """
    q = queries.select("qid", F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    c = corpus.select("id", F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    schema = f"qid {_kind(q, 'qid')}, id {_kind(c, 'id')}, score double"
    axis = 1 if of == "query" else 0
    held = q.limit(block + 1).collect()
    if len(held) <= block:
        out = _against(held, "qid", q, c, "id", schema, lambda few, many: _cell(few, many, keep, axis, decimals))
    else:
        small = c.limit(block + 1).collect()
        if len(small) <= block:
            out = _against(small, "id", c, q, "qid", schema, lambda few, many: _cell(many, few, keep, axis, decimals))
        else:
            out = _grid(q, c, block, rows, schema, lambda left, right: _cell(left, right, keep, axis, decimals))
    if not keep:
        return out
    if of == "query":
        return best(out, keep)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "qid")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _against(held: list, key: str, few: DataFrame, many: DataFrame, other: str, schema: str, cell) -> DataFrame:
    """One pass over ``many`` with the few vectors ``held`` in every task."""
    spark = many.sparkSession
    if not held:
        return spark.createDataFrame([], schema)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kind = kinds[_kind(few, key)]
    keys, vecs = [r[0] for r in held], [list(r[1]) for r in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pa.table({key: pa.array(keys, kind), "vec": pa.array(vecs, pa.list_(pa.float64()))})
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                yield from cell(mine, pa.Table.from_batches([whole.slice(start, 4096)])).combine_chunks().to_batches()

    return many.select(other, "vec").mapInArrow(run, schema)


def _grid(q: DataFrame, c: DataFrame, block: int, rows: int, schema: str, cell) -> DataFrame:
    """Every block of ``q`` with every block of ``c``: each side is sent once per block of the other."""
    n_q, n_c = max(1, -(-q.count() // block)), max(1, -(-c.count() // rows))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("qid", "vec", own("qid", n_q).alias("qb"), every(n_c).alias("cb")).repartition(n_q * n_c, "qb", "cb")
    right = c.select("id", "vec", own("id", n_c).alias("cb"), every(n_q).alias("qb")).repartition(n_q * n_c, "qb", "cb")
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(lambda a, b: cell(a.combine_chunks(), b.combine_chunks()), schema)


def cell_means(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell, vec``: unit means of the rows (``id, vec``) of every cell (``id, cell``); combined on the map side."""
    means = mean_coordinates(rows.join(cells, "id"), "cell", "vec").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("m"))
    return means.select("cell", unit(F.transform("m", lambda x: x["mean"])).alias("vec")).where("vec is not null")


def coarse_cells(rows: DataFrame, n_cells: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Spherical k-means of ``rows`` (id, vec) into at most ``n_cells`` cells: ``id, cell`` and the unit means ``cell, vec``.

    The start is the rows with the smallest hashes; every round gives all rows to their nearest mean, in one pass.
    """
    work = Workspace(rows.sparkSession, "cells")
    start = rows.orderBy(F.xxhash64("id"), "id").limit(n_cells).select("vec")
    means = work.write(start.withColumn("cell", F.row_number().over(Window.orderBy("vec")) - 1).select("cell", "vec"), "means")  # at most n_cells rows
    cells = None
    for _ in range(rounds):
        near = products(means.withColumnRenamed("cell", "qid"), rows, keep=1, of="row")
        cells = work.write(near.select("id", F.col("qid").alias("cell")), "members")
        means = work.write(cell_means(rows, cells), "means")
    return cells, means


def coarse_nearest(items: DataFrame, rows: DataFrame, n_cells: int = 256, probes: int = 1) -> DataFrame:
    """``id, pid, score``: for each item (``id, vec``) the nearest of ``rows`` (``id, vec``) among the rows of its ``probes`` nearest cells.

    Rows are clustered into cells first; items meet the cell means and then, by an equi-join on the cell, the rows of their
    cells only. Ties go to the smaller key. The nearest row of all may lie in another cell: that is the loss, and ``probes`` buys it back.
    """
    cells, means = coarse_cells(rows, n_cells)
    asked = products(means.withColumnRenamed("cell", "qid"), items, keep=probes, of="row").select("id", F.col("qid").alias("cell"))
    left = items.join(asked, "id").select(F.col("id").alias("qid"), "vec", "cell")
    right = rows.join(cells, "id").select("id", "vec", "cell")
    schema = f"qid {_kind(left, 'qid')}, id {_kind(right, 'id')}, score double"
    # A cell that draws many items is met in batches of its items, each with the rows of the cell.
    batch = 20_000
    sizes = left.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("salts")).where("salts > 1")
    left = left.join(F.broadcast(sizes), "cell", "left").withColumn("salt", F.pmod(F.xxhash64("qid"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")  # at most n_cells rows
    right = right.join(F.broadcast(sizes), "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    met = left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(lambda a, b: _cell(a.combine_chunks(), b.combine_chunks(), 1, 1, 9), schema)
    return best(met, 1).select(F.col("qid").alias("id"), F.col("id").alias("pid"), "score")


def best(scores: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` and keeps the ``k`` best of each query: highest score, ties to the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
