"""Approximate nearest neighbours by collision-counting hashing, largest inner product.

Vectors are lifted by one coordinate so that inner-product order becomes distance order, then
projected on ``lines`` random directions. Each data block keeps its projections as sorted
arrays. A query counts in how many arrays a vector falls inside the window centred on the
query; windows widen (virtual rehashing) until enough vectors reach the collision threshold,
and exactly those are verified with the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colloquia.llm.common import durable, pick

NEAREST = 20
LINES, THRESHOLD = 96, 0.7
WINDOW, GROWTH, ROUNDS = 0.8, 1.2, 12
ENOUGH, ENOUGH_ROWS = 0.08, 400  # share and number of a block's vectors that are verified at least
BLOCK_ROWS, QUERY_ROWS = 20000, 1500
SEED = 11


def usable(vector) -> object:
    """Not null, not empty, all components finite, not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & F.coalesce(~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


def search_block(ids, data, query_ids, queries, longest, k, lines, threshold, window, growth, rounds, enough):
    """Rows (query id, vector id, score): the k best verified candidates of one block for each query."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    directions = np.random.default_rng(SEED).standard_normal((lines, data.shape[1] + 1))
    lifted = np.sqrt(np.maximum(0, 1 - (data * data).sum(axis=1) / longest**2))
    keys = np.column_stack([data / longest, lifted]) @ directions.T
    order = np.argsort(keys, axis=0, kind="stable").T
    arrays = np.take_along_axis(keys.T, order, axis=1)
    place = np.empty(order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)  # of each vector in each sorted array
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(ids), dtype=place.dtype), order.shape), axis=1)
    centres = (queries / np.sqrt((queries * queries).sum(axis=1))[:, None]) @ directions[:, :-1].T
    needed, wanted = int(np.ceil(threshold * lines)), k + 1 + max(ENOUGH_ROWS, int(enough * len(ids)))
    widths = [window * growth**r for r in range(rounds)] + [np.inf]
    low = np.stack([[np.searchsorted(arrays[j], centres[:, j] - w) for j in range(lines)] for w in widths]).astype(place.dtype)
    high = np.stack([[np.searchsorted(arrays[j], centres[:, j] + w, side="right") for j in range(lines)] for w in widths]).astype(place.dtype)
    moved, inside = np.empty_like(place), np.empty(place.shape, np.uint8)
    last = 0
    for q in range(len(query_ids)):
        for r in range(max(0, last - 1), len(widths)):  # one step inside the window of the query before
            since, wide = low[r, :, q, None], (high[r, :, q] - low[r, :, q])[:, None]
            np.less(np.subtract(place, since, out=moved), wide, out=inside.view(bool))  # unsigned: places below the window wrap
            met = sum(np.add.reduce(inside[j : j + 255], axis=0, dtype=np.uint8).astype(np.uint16) for j in range(0, lines, 255))
            found = met >= needed
            if np.count_nonzero(found) >= wanted:
                break
        last = r
        rows = np.flatnonzero(found & (ids != query_ids[q]))
        score = (data[rows] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[rows][best], score[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def nearest(vectors: DataFrame, is_query="vec_id % 20 = 0", k: int = NEAREST, lines: int = LINES, threshold: float = THRESHOLD, window: float = WINDOW,
            growth: float = GROWTH, rounds: int = ROUNDS, enough: float = ENOUGH, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest found of every query row, over all rows but its own.

    Returns query_id, rank (from 1), vec_id, score. Unusable vectors (null, zero, null or
    non-finite components), rows without id, and vectors that have not the commonest length
    (of equally common ones the smaller) take no part. Ids are expected to be unique;
    of rows with one id a single one is used. Equal scores go by smaller vec_id: all vectors
    over the threshold are verified, however many share a place. Blocks have about
    ``block_rows`` rows, so one task holds one block and one block of queries at any size.
    """
    rows = pick(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(is_query), 1)).alias("q"), F.max(norm).alias("longest")).orderBy(F.desc("n"), "size").first()
    stats = stats or {"size": 0, "n": 0, "q": 0, "longest": 1.0}
    rows, longest = rows.filter(F.size("v") == stats["size"]), float(np.sqrt(stats["longest"]))
    blocks, query_blocks = max(1, -(-stats["n"] // block_rows)), max(1, -(-stats["q"] // query_rows))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = rows.withColumn("block", place(blocks)).withColumn("query_block", every(query_blocks))
    asked = rows.filter(is_query).withColumn("query_block", place(query_blocks)).withColumn("block", every(blocks))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        ids, at = np.unique(left["vec_id"].to_numpy(), return_index=True)
        query_ids, query_at = np.unique(right["vec_id"].to_numpy(), return_index=True)
        found = search_block(ids, matrix(left["v"])[at], query_ids, matrix(right["v"])[query_at], longest, k, lines, threshold, window, growth, rounds, enough)
        return pa.table(found, names)

    cells = data.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
