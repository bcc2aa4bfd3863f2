"""Mixing sources to target weights by capped water-filling.

Each source gets a share of a word budget by weight, never above ``epochs`` times its own
size; what a capped source cannot take is dealt again to the others. A source's target is
met by whole repetitions of all its documents and one more, fractional repetition: the
documents with the smallest seeded keys, up to a key bound found per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colloquia.llm.common import durable, pick, ranked, whole, word_count

SEED = "mix-7"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
KEY_BITS, BUCKET_BITS = 60, 14
SMALL_PLAN = 10000  # sources up to which the plan (one short row each) is broadcast


def seeded_key(seed: str) -> Column:
    """60 pseudo-random bits of a document, from its id and whole text."""
    digest = F.md5(F.concat(F.lit(seed + "|"), whole(F.col("doc_id").cast("string")), F.lit("|"), whole(F.col("text"))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document its size in words, its source (null apart from empty) and its seeded key."""
    return pick(docs, "doc_id", "text", "source").select(
        "doc_id", "source", F.col("source").isNull().alias("no_source"), whole(F.col("source")).alias("of"),
        word_count(F.col("text")).alias("size"), seeded_key(seed).alias("key"))


def water_level(sources: DataFrame, budget: float) -> float:
    """The level at which min(level * weight, cap), summed over sources, spends ``budget``.

    Rounds of clamping: sources at or below the level keep their cap, the rest of the budget
    is dealt to the others by weight, which can only raise the level. Two numbers a round
    come to the driver, whatever the number of sources.
    """
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("cap"))).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return float("inf")
        new = (budget - (row["spent"] or 0)) / row["open"]
        if level is not None and new <= level:
            return level
        level = new


def source_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: its size, target, whole repetitions and the key bound of the fractional one.

    The bound comes from sums of 2^14 key buckets per source (made map-side), then from the
    order inside the one bucket where the target falls, so a hot source never meets in one
    task. The document on the border is taken if at least half of it fits.
    """
    sizes = durable(rows.groupBy("no_source", "of").agg(F.sum("size").alias("source_size")))
    budget = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    sources = ranked(sizes, "no_source", "of", name="turn").select(
        "no_source", "of", "source_size", turn.alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    level = F.lit(water_level(sources, budget))
    plan = sources.withColumn("target", F.when(F.col("cap") <= level * F.col("weight"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = durable(plan.withColumn("times", times.cast("long")).withColumn("part", F.col("target") - F.col("times") * F.col("source_size")))

    bucket = F.shiftright("key", KEY_BITS - BUCKET_BITS)
    sums = rows.groupBy("no_source", "of", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    upto = F.sum("in_bucket").over(W.partitionBy("no_source", "of").orderBy("bucket"))  # at most 2^14 rows a source
    border = sums.withColumn("upto", upto).join(plan, ["no_source", "of"]).filter(
        (F.col("upto") >= F.col("part")) & (F.col("upto") - F.col("in_bucket") < F.col("part"))).select(  # one a source with a part
        "no_source", "of", "bucket", "part", (F.col("upto") - F.col("in_bucket")).alias("below"))
    inside = rows.withColumn("bucket", bucket).join(border, ["no_source", "of", "bucket"]).groupBy(
        "no_source", "of", "bucket", "part", "below", "key").agg(F.sum("size").alias("here"))
    before = F.col("below") + F.sum("here").over(W.partitionBy("no_source", "of").orderBy("key")) - F.col("here")
    bounds = inside.withColumn("before", before).groupBy("no_source", "of").agg(
        F.max(F.when((F.col("before") < F.col("part")) & (2 * F.col("before") + F.col("here") <= 2 * F.col("part")), F.col("key"))).alias("last"),
        F.min(F.shiftleft(F.col("bucket"), KEY_BITS - BUCKET_BITS) - 1).alias("floor"))
    found = plan.join(bounds, ["no_source", "of"], "left").select(
        "no_source", "of", "source_size", "target", "times",
        F.when(F.col("part") <= 0, F.lit(-1)).otherwise(F.coalesce("last", "floor")).cast("long").alias("bound"))
    found = durable(found)
    return F.broadcast(found) if found.count() <= SMALL_PLAN else found  # larger ones are left to Spark's skew join


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document how often the mix takes it.

    Returns doc_id, source, size, source_size, target, copies (repetitions of the whole text)
    and taken (words: copies * size). A null text has size 0, null is a source of its own and
    comes last. Rows equal in doc_id and text share a key and are taken alike. An empty table
    gives no rows; with no words at all every target is 0.
    """
    rows = durable(keyed(docs, seed))
    plan = source_plan(rows, weights, share, epochs)
    copies = F.col("times") + (F.col("key") <= F.col("bound")).cast("long")
    return rows.join(plan, ["no_source", "of"]).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, whole, with all its columns."""
    plan = source_plan(durable(keyed(docs, seed).drop("doc_id", "source")), **options)
    row = F.struct(*[F.col(f"c{i}") for i in range(len(docs.columns))]).alias("row")
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    named = [F.col(f"c{docs.columns.index(n)}").alias(n) for n in ("doc_id", "text", "source")]
    rows = flat.select(row, *named).select(
        "row", F.col("source").isNull().alias("no_source"), whole(F.col("source")).alias("of"), seeded_key(seed).alias("key"))
    copies = F.col("times") + (F.col("key") <= F.col("bound")).cast("long")
    taken = rows.join(plan, ["no_source", "of"]).withColumn("copies", copies).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*").toDF(*docs.columns)
