"""Ordered operators that do not funnel one hot key through one task.

A plain ``Window.partitionBy(group)`` sorts a whole group in one task, however large.
The helpers here split each group's ordered rows into buckets, run the window inside
(group, bucket), summarise every bucket to one row, and carry the summaries across
buckets. Only the bucket summaries are ever ordered per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquia.session import durable

DAY_SECONDS = 86400


def time_bucket(column: str | Column, width: int = DAY_SECONDS) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value / F.lit(width)).cast("long")


def split_window(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], **outputs: tuple[str, Column]) -> DataFrame:
    """Window results over (keys, order) computed per (keys, bucket) plus carried summaries.

    ``bucket`` must be non-decreasing along ``order`` inside a key. ``df`` is read twice (rows
    and summaries), so callers pass a cut (``durable``) frame unless it is cheap to read. Each
    output is
    ``name=(kind, column)`` with kind one of ``prev`` ``next`` (neighbour row's value),
    ``max_before`` ``max_through`` ``sum_through`` (running frames) and ``key_max``.
    """
    keys = list(keys)
    parts = [*keys, bucket]
    base = df.select("*", *[expr.alias(f"_in_{n}") for n, (_, expr) in outputs.items()])
    base = base.repartition(*[F.col(c) for c in parts])
    local = Window.partitionBy(*parts).orderBy(*[F.col(c).asc() for c in order])
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    through = local.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(bucket)
    across_before = across.rowsBetween(Window.unboundedPreceding, -1)
    across_all = Window.partitionBy(*keys)
    position = F.struct(*[F.col(c) for c in order])

    local_cols, summary_cols, carry_cols, final_cols = [], [], [], []
    for name, (kind, _) in outputs.items():
        value, mine, total, carry = F.col(f"_in_{name}"), f"_l_{name}", f"_s_{name}", f"_c_{name}"
        boxed = F.struct(value.alias("v"))
        if kind == "prev":
            local_cols.append(F.lag(boxed).over(local).alias(mine))
            summary_cols.append(F.max_by(boxed, position).alias(total))
            carry_cols.append(F.lag(total).over(across).alias(carry))
            final_cols.append(F.coalesce(F.col(mine), F.col(carry))["v"].alias(name))
        elif kind == "next":
            local_cols.append(F.lead(boxed).over(local).alias(mine))
            summary_cols.append(F.min_by(boxed, position).alias(total))
            carry_cols.append(F.lead(total).over(across).alias(carry))
            final_cols.append(F.coalesce(F.col(mine), F.col(carry))["v"].alias(name))
        elif kind in ("max_before", "max_through"):
            local_cols.append(F.max(value).over(before if kind == "max_before" else through).alias(mine))
            summary_cols.append(F.max(value).alias(total))
            carry_cols.append(F.max(total).over(across_before).alias(carry))
            final_cols.append(F.greatest(F.col(mine), F.col(carry)).alias(name))
        elif kind == "sum_through":
            local_cols.append(F.sum(value).over(through).alias(mine))
            summary_cols.append(F.sum(value).alias(total))
            carry_cols.append(F.sum(total).over(across_before).alias(carry))
            final_cols.append((F.coalesce(F.col(mine), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))).alias(name))
        elif kind == "key_max":
            summary_cols.append(F.max(value).alias(total))
            carry_cols.append(F.max(total).over(across_all).alias(carry))
            final_cols.append(F.col(carry).alias(name))
        else:
            raise ValueError(f"unknown window kind: {kind}")

    detail = base.select("*", *local_cols)
    carried = base.groupBy(*parts).agg(*summary_cols).select(*parts, *carry_cols)
    return detail.join(carried, parts).select(*[F.col(c) for c in df.columns], *final_cols)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key with their rank; all rows where ``n`` is None.

    Spark keeps the first ``n`` of a key in every task before the shuffle (the session sets
    ``windowGroupLimitThreshold`` beyond any ``n`` in use), so a hot key's final sort sees at
    most ``n`` rows per map task.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))
    return (ranked if n is None else ranked.filter(F.col(rank) <= n)).withColumn(rank, F.col(rank).cast("long"))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """1-based position of every row inside its key; safe for a key holding most rows.

    One range shuffle by (keys, order). A row's place in its sorted partition is known without
    another shuffle; each (partition, key) adds one offset row, and those are joined back.
    """
    keys = list(keys)
    cut = durable(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).sortWithinPartitions(*keys, *order))
    at = cut.withColumn("_at", F.monotonically_increasing_id())
    placed = at.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    held = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_add"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(offsets, same).select(*[F.col(c) for c in df.columns], (F.col("_at") + F.col("_add")).cast("long").alias(name))


def lookup(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Left join on ``key`` (a column of both), where many rows of ``df`` may have none.

    A join sends all null keys to one task. Here each such row gets a key of its own that no row
    of ``found`` has, so they spread and match nothing. ``key`` is text.
    """
    alone = F.concat(F.lit("?"), F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
    right = found.filter(F.col(key).isNotNull()).withColumn("_key", F.concat(F.lit("="), F.col(key))).drop(key)
    return df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key)), alone)).join(right, "_key", "left").drop("_key")


def positions(ordered: DataFrame, name: str = "position") -> DataFrame:
    """1-based place of every row of a globally ordered frame, as it stands: rows keep their
    partition and place, and one count a partition gives the offsets."""
    at = durable(ordered).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for row in sorted(at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((row["part"], total))
        total += row["n"]
    offsets = ordered.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return at.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + place + 1).drop("_part", "_start", "_at")


def first_after(probes: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """As-of join: the first candidate in ``[t, t+window]`` sent by somebody else.

    ``probes``: group_id, sent_at, sender. ``candidates``: group_id, sent_at, ord, sender
    plus a ``payload`` column. Blank senders never count as the same person. Candidates
    are reduced to two per (group, second), the first and the first of another sender;
    that is all any probe can need, so cost stays linear and no group is paired with itself.
    Returns the distinct probes with ``payload`` (null when unanswered) and ``answer_at``,
    ``answer_sender``.
    """
    per_sender = candidates.groupBy("group_id", "sent_at", "sender").agg(
        F.min("ord").alias("ord"), F.min_by("payload", "ord").alias("payload"))
    # a blank sender is nobody: keep only its first, it satisfies every probe anyway
    two = top_per_key(per_sender, ["group_id", "sent_at"], [F.col("ord").asc()], 2, "_r").drop("_r")
    seconds = probes.select("group_id", "sent_at").distinct()
    bucket = time_bucket("sent_at", window)
    there = two.select(
        "group_id", F.explode(F.array(bucket, bucket - 1)).alias("_bucket"), "sent_at",
        F.lit(1).alias("_kind"), "ord",
        F.struct("sent_at", "sender", "payload").alias("_c"))
    here = seconds.select(
        "group_id", bucket.alias("_bucket"), "sent_at", F.lit(0).alias("_kind"),
        F.lit(None).cast(two.schema["ord"].dataType).alias("ord"),
        F.lit(None).cast(there.schema["_c"].dataType).alias("_c"))
    flow = Window.partitionBy("group_id", "_bucket").orderBy("sent_at", "_kind", F.col("ord").asc_nulls_first())
    previous_sender = F.last("_c.sender", ignorenulls=True).over(flow.rowsBetween(Window.unboundedPreceding, -1))
    # the frame "everything after" as a descending running frame, which is linear
    ahead = Window.partitionBy("group_id", "_bucket").orderBy(
        F.col("sent_at").desc(), F.col("_kind").desc(), F.col("ord").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    marked = there.unionByName(here).withColumn(
        "_run", F.when(F.col("_c").isNotNull() & (previous_sender.isNull() | (previous_sender != F.col("_c.sender"))), F.col("_c")))
    chained = marked.withColumn("_alt", F.last("_run", ignorenulls=True).over(ahead)).withColumn(
        "_both", F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("one"), F.col("_alt").alias("two"))))
    found = chained.withColumn("_near", F.last("_both", ignorenulls=True).over(ahead)).filter(F.col("_kind") == 0)
    lookup = found.select("group_id", "sent_at", "_near")
    one, two_ = F.col("_near.one"), F.col("_near.two")
    same = (F.col("sender") != "") & (one["sender"] == F.col("sender"))
    pick = F.when(same, two_).otherwise(one)
    joined = probes.select("group_id", "sent_at", "sender").distinct().join(lookup, ["group_id", "sent_at"], "left")
    hit = joined.withColumn("_hit", pick).withColumn(
        "_hit", F.when(F.col("_hit.sent_at") - F.col("sent_at") <= window, F.col("_hit")))
    return hit.select("group_id", "sent_at", "sender", F.col("_hit.payload").alias("payload"),
                      F.col("_hit.sent_at").alias("answer_at"), F.col("_hit.sender").alias("answer_sender"))


def recent_before(probes: DataFrame, facts: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """Count and latest payload of the facts in ``[t-window, t]`` for every distinct probe.

    ``probes``: keys + sent_at. ``facts``: keys + sent_at, ord, payload. Facts are reduced
    to one row per (keys, second) and copied to the following bucket, so a range frame
    inside (keys, bucket) sees all it needs. Among equal times the lowest ``ord`` wins.
    """
    keys = list(keys)
    bucket = time_bucket("sent_at", window)
    per_second = facts.groupBy(*keys, "sent_at").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("payload", "ord").alias("_p"))
    there = per_second.select(*keys, F.explode(F.array(bucket, bucket + 1)).alias("_bucket"), "sent_at", "_n",
                              F.struct("sent_at", F.col("_p").alias("payload")).alias("_f"), F.lit(0).alias("_kind"))
    here = probes.select(*keys, "sent_at").distinct().select(
        *keys, bucket.alias("_bucket"), "sent_at", F.lit(0).cast("long").alias("_n"),
        F.lit(None).cast(there.schema["_f"].dataType).alias("_f"), F.lit(1).alias("_kind"))
    frame = Window.partitionBy(*keys, "_bucket").orderBy("sent_at").rangeBetween(-window, 0)
    latest = Window.partitionBy(*keys, "_bucket").orderBy("sent_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = there.unionByName(here).withColumn("n_before", F.sum("_n").over(frame)).withColumn(
        "_last", F.last("_f", ignorenulls=True).over(latest)).filter(F.col("_kind") == 1)
    return seen.select(*keys, "sent_at", "n_before",
                       F.when(F.col("n_before") > 0, F.col("_last.payload")).alias("latest"))


def points_in_windows(points: DataFrame, windows: DataFrame, keys: Sequence[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Range join ``start <= point < end`` on equal keys through shared time buckets.

    A window is copied into each bucket it touches, so a row meets only the windows near
    it. The copies are streamed over the points of their bucket: of a bucket only its points
    are held. Give both sides already reduced to what the caller needs (see the callers).
    """
    left = points.withColumn("_bucket", time_bucket(point, width))
    right = windows.filter(F.col(start) < F.col(end)).withColumn(
        "_bucket", F.explode(F.sequence(time_bucket(start, width), time_bucket(F.col(end) - 1, width))))
    return right.join(left, [*keys, "_bucket"]).filter(
        (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")
