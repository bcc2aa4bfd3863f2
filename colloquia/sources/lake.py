"""Keyed Parquet tables whose maintenance touches only the partitions a delta falls into.

A table is laid out by a hash bucket of its leading keys and, where rows have a time, by day.
Keyed tables are rewritten partition by partition with dynamic partition overwrite; append-only
tables find repeated keys in the delta's own days, and elsewhere through membership sketches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquia.session import durable

BUCKET, DAY, BATCH = "_bucket", "_day", "_batch"
SKETCH_BITS = 32768  # bits of one sketch block, the size of Spark's bitmap aggregate
SKETCH_BLOCKS = 64  # blocks of a (bucket, day, batch); about 200,000 keys at ten bits a key
PROBES = 4


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row per ``keys``, bucketed by ``by`` (leading keys that never change for a row).

    ``merge(stored, delta)`` gets the stored rows of the touched buckets and returns all rows
    that belong there; it must treat each key by itself, as the rules in ``upserts`` do.
    """
    path: str
    by: tuple[str, ...]
    buckets: int = 256

    def read(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        """The whole table with the columns of ``like``; empty before the first write."""
        if not exists(spark, self.path):
            return like.limit(0)
        schema = T.StructType([*like.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return spark.read.schema(schema).parquet(self.path).select(*like.columns)

    def touched(self, delta: DataFrame) -> list[int]:
        """Buckets that ``delta`` falls into: at most ``buckets`` small numbers."""
        return sorted(r[0] for r in delta.select(bucket_of(self.by, self.buckets)).distinct().collect())

    def part(self, spark: SparkSession, like: DataFrame, touched: list[int]) -> DataFrame:
        """Stored rows of some buckets; others are not opened (a partition filter)."""
        if not touched or not exists(spark, self.path):
            return like.limit(0)
        schema = T.StructType([*like.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return spark.read.schema(schema).parquet(self.path).filter(F.col(BUCKET).isin(touched)).select(*like.columns)

    def upsert(self, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], like: DataFrame | None = None) -> list[int]:
        """Fold ``delta`` in and return the rewritten buckets. Running it again changes nothing if
        ``merge`` is idempotent; files of untouched buckets stay as they are.

        ``like`` has the stored columns where the delta's differ. New rows are cut before the old
        files go, so a failed job leaves the old partition.
        """
        spark, delta = delta.sparkSession, durable(delta)
        touched = self.touched(delta)
        merged = durable(merge(self.part(spark, delta if like is None else like, touched), delta).withColumn(BUCKET, bucket_of(self.by, self.buckets)))
        merged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        filled = {r[0] for r in merged.select(BUCKET).distinct().collect()}
        for bucket in set(touched) - filled:  # every row of the bucket went away
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        return touched


def _probes(keys: Sequence[str]) -> tuple[Column, list[Column]]:
    """(block, bit positions in it) of a key in a membership sketch."""
    names = [F.col(k).cast("string") for k in keys]
    block = F.pmod(F.xxhash64(F.lit("block"), *names), F.lit(SKETCH_BLOCKS)).cast("int")
    return block, [F.pmod(F.xxhash64(F.lit(i), *names), F.lit(SKETCH_BITS)).cast("int") for i in range(PROBES)]


def _bit(bits: Column, position: Column) -> Column:
    """Whether a bit of a binary bitmap is set (lowest bit first in each byte)."""
    byte = F.conv(F.hex(F.substring(bits, F.lit(1) + F.floor(position / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, position % 8) == 1


@dataclass(frozen=True)
class EventLake:
    """Append-only rows with a unique key and a time, by (bucket, day, batch).

    A batch writes its own folders in overwrite mode and looks only at batches before it, so a
    batch that runs again after a failure gives the same rows.
    """
    path: str
    keys: tuple[str, ...] = ("group_id", "row_id")
    by: tuple[str, ...] = ("group_id",)
    time: str = "sent_at"
    buckets: int = 64

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    @property
    def sketch_path(self) -> str:
        return f"{self.path}/sketches"

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, bucket_of(self.by, self.buckets)).withColumn(DAY, F.floor(F.coalesce(F.col(self.time), F.lit(0)) / 86400).cast("int"))

    def read(self, spark: SparkSession, like: DataFrame, before: int | None = None, places: list[tuple[int, int]] | None = None) -> DataFrame:
        """Stored rows with their batch; ``before`` hides later batches, ``places`` opens only some (bucket, day)."""
        extra = [T.StructField(BUCKET, T.IntegerType()), T.StructField(DAY, T.IntegerType()), T.StructField(BATCH, T.LongType())]
        schema = T.StructType([f for f in like.schema.fields if f.name not in (BUCKET, DAY, BATCH)] + extra)
        if not exists(spark, self.rows_path):  # nothing was written yet; any other failure to read must rise
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(self.rows_path)
        if before is not None:
            rows = rows.filter(F.col(BATCH) < before)
        if places is not None:
            rows = rows.filter((F.col(BUCKET).cast("long") * (1 << 32) + F.col(DAY)).isin([b * (1 << 32) + d for b, d in places]))
        return rows

    def places(self, delta: DataFrame, batch: int) -> list[tuple[int, int]]:
        """(bucket, day) that may hold a key of ``delta``: its own, and those whose sketch has all bits of a key.

        Only sketches of the delta's buckets are read, ten bits a key. Small number pairs come to the driver.
        """
        spark, placed = delta.sparkSession, self._placed(delta)
        own = {(r[0], r[1]) for r in placed.select(BUCKET, DAY).distinct().collect()}
        if not own or not exists(spark, self.sketch_path):
            return sorted(own)
        block, probes = _probes(self.keys)
        wanted = placed.select(BUCKET, DAY, block.alias("block"), *[p.alias(f"p{i}") for i, p in enumerate(probes)])
        schema = f"{DAY} int, block int, bits binary, {BUCKET} int, {BATCH} long"
        kept = spark.read.schema(schema).parquet(self.sketch_path).filter(F.col(BUCKET).isin(sorted({b for b, _ in own})) & (F.col(BATCH) < batch))
        hit = wanted.withColumnRenamed(DAY, "_own").join(kept, [BUCKET, "block"]).filter(F.col("_own") != F.col(DAY))
        for i in range(PROBES):
            hit = hit.filter(_bit(F.col("bits"), F.col(f"p{i}")))
        return sorted(own | {(r[0], r[1]) for r in hit.select(BUCKET, DAY).distinct().collect()})

    def append(self, delta: DataFrame, fresh: Callable[[DataFrame, DataFrame], DataFrame], batch: int) -> list[tuple[int, int]]:
        """Write ``fresh(stored, delta)`` as batch ``batch``; ``stored`` has the rows of every place that can hold a key
        of ``delta``. Returns the places that were opened."""
        spark, delta = delta.sparkSession, durable(delta)
        places = self.places(delta, batch)
        stored = self.read(spark, delta, batch, places)
        new = durable(self._placed(fresh(stored, delta)).withColumn(BATCH, F.lit(batch).cast("long")))
        parts = [BUCKET, DAY, BATCH]
        block, probes = _probes(self.keys)
        bits = new.select(*parts, block.alias("block"), F.explode(F.array(*probes)).alias("bit")).groupBy(*parts, "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
        # sketches first: a sketch without rows costs one look, rows without a sketch could be stored twice
        bits.hint("rebalance", BUCKET, BATCH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH).parquet(self.sketch_path)
        new.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self.rows_path)
        return places
