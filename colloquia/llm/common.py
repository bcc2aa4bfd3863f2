"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquia.session import durable

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine find the package also where it is not installed (on a
    cluster, install it or pass it with ``--py-files``)."""
    root, own = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [root, own.get("PYTHONPATH")]))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever other columns (``TEXT``, ``size``) the table has."""
    marks = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*marks).select(*[F.col(marks[df.columns.index(n)]).alias(n) for n in names])


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(whole(text), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them twice: pieces of the split minus empty ends."""
    t = whole(text)
    ends = F.substring(t, 1, 1).rlike(GAP).cast("long") + F.substring(t, -1, 1).rlike(GAP).cast("long")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, GAP)).cast("long") - ends).cast("long")


def ranked(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """Append the 0-based rank of each row in the order of ``keys`` (nulls first).

    A range shuffle, then one number per partition: no task sees more than its range, and a
    hot key is split as long as later keys differ. Rows equal in all keys get distinct ranks
    in any order. The sorted rows are checkpointed, so ranges cannot move on a retry. The
    range shuffle samples its input first: ``df`` should be cheap to compute twice.
    """
    cut = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    at = cut.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # one small row a partition
    starts, total = [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        starts.append((row["_part"], total))
        total += row["_n"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return at.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_start") + place).drop("_part", "_start", "_at")
