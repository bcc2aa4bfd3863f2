"""Sharding along a Hilbert curve over several quantised metadata dimensions.

Rows close on the curve are close in every dimension, so a shard (a run of the curve) has a
narrow range of each and readers can skip shards by any of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia.llm.common import durable, pick, ranked, whole

SHARDS = 24
BITS = 6
SMALL_RANKS = 10000  # distinct values up to which their ranks are broadcast


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows, dimensions), each below 2^bits.

    The usual transpose form: undo the rotations from the top bit down, Gray-encode, then
    interleave the bits of all dimensions.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            turned = (x[d] >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def value_ranks(rows: DataFrame, name: str) -> DataFrame:
    """Add ``name``_order: the rank of the whole value among all distinct ones; null comes first."""
    values = durable(rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")))
    ranks = durable(ranked(values, name, name=f"{name}_order").select(F.col(name).alias("_value"), f"{name}_order"))
    side = F.broadcast(ranks) if ranks.count() <= SMALL_RANKS else ranks
    return rows.join(side, rows[name].eqNullSafe(side["_value"])).drop("_value")


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Add the quantile cell of each numeric dimension, 0 to 2^bits - 1, cut over all rows.

    A frequent value covers several quantiles and counts as many cells, so a dimension with
    few values still spreads over the whole range.
    """
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(d, steps, 10000).alias(d) for d in dims]).first()
    cell = lambda d: sum(((F.col(d) > F.lit(c)).cast("int") for c in cuts[d] or []), F.lit(0))
    return df.withColumns({f"{d}_cell": cell(d) for d in dims})


def slim(rows: DataFrame, *more: str) -> DataFrame:
    text = whole(F.col("text"))
    return rows.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), "source", "lang", *more)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Deal all documents into ``shards`` runs of the curve over (source, lang, text size).

    Returns doc_id, size (UTF-8 bytes plus 8; a null text has none), text_crc32, curve, the
    three cells, shard and slot, besides source and lang and their ranks. Shard counts differ by one at most (law ``rows``); slots are
    gapless from 0. Ties on the curve go by doc_id, then by checksum; equal rows take
    neighbouring slots. Null metadata sort first. An empty table gives no rows.
    """
    rows = durable(slim(pick(docs, "doc_id", "text", "lang", "source")))

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c], axis=1).reshape(-1, 3), bits))

    cells = quantised(value_ranks(value_ranks(rows, "source"), "lang"), ["source_order", "lang_order", "size"], bits)
    placed = cells.withColumn("curve", curve("source_order_cell", "lang_order_cell", "size_cell"))
    order = ranked(placed, "curve", "doc_id", "text_crc32", name="place")
    total = max(1, rows.count())
    # shard s starts at the least place p with p * shards div total = s
    return order.withColumn("shard", F.expr(f"cast(place * {shards} div {total} as int)")).withColumn(
        "slot", F.expr(f"place - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}")).drop("place")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """The pruning table: per shard its rows, bytes and the range of every dimension, also by its real values (besides nulls)."""
    dims = ["source_order", "lang_order", "size", "curve", "source", "lang"]
    ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("least", F.min), ("most", F.max))]
    nulls = [F.count_if(F.col(d).isNull()).alias(f"null_{d}") for d in ("source", "lang")]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ends, *nulls)


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Write all documents with all columns and their slot shard by shard, each shard sorted along the curve.

    Takes the result of ``hilbert_shards`` on the same rows. Both sides are ranked by what places a
    row and joined on the rank, so null ids and repeated rows each get a slot of their own. Tasks
    take ranges of (shard, slot), so a large shard is several files, in order.
    """
    keys = [k for k in ("doc_id", "text_crc32", "size", "source", "lang") if k in sharded.columns]
    marks = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*marks).withColumn("row", F.struct(*marks))
    named = [F.col(marks[docs.columns.index(n)]).alias(n) for n in ("doc_id", "text", "source", "lang")]
    rows = ranked(slim(flat.select("row", *named), "row"), *keys, name="place")
    placed = ranked(sharded.select(*keys, "shard", "slot"), *keys, name="place")
    sums = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys).cast("decimal(38,0)"))).first() for d in (rows, placed)]
    if tuple(sums[0]) != tuple(sums[1]):
        raise ValueError("the shards were made of other documents")
    out = rows.select("row", "place").join(placed.select("place", "shard", "slot"), "place").select("row.*", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").toDF(*docs.columns, "shard", "slot").write.partitionBy("shard").parquet(path)
