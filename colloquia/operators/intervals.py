"""Interval calculus over scanned ranges: merge, gaps, overlap, slots, backfill plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia.operators.ordered import split_window, time_bucket
from colloquia.session import durable

BACKFILL_CHUNK_SECONDS = 24 * 60 * 60
SLOT_SECONDS_BY_DAYS = {1: 3600, 7: 6 * 3600, 30: 86400}
LOCAL_OFFSET_SECONDS = 8 * 3600


def coverage_edges(ranges: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Rows that open a merged interval, with the furthest end before them and of the key.

    Ranges are first reduced to one row per (key, start second), so a day bucket never
    holds more than 86,400 rows of a key, however many ranges were recorded.
    """
    keys = list(keys)
    spans = ranges.groupBy(*keys, "start_unix").agg(F.max("end_unix").alias("end_unix"))
    spans = durable(spans.withColumn("_day", time_bucket("start_unix")))
    scanned = split_window(spans, keys, "_day", ["start_unix"],
                           prev_end=("max_before", F.col("end_unix")), last_end=("key_max", F.col("end_unix")))
    opens = F.col("prev_end").isNull() | (F.col("start_unix") > F.col("prev_end"))
    return scanned.filter(opens).select(*keys, "start_unix", "prev_end", "last_end")


def merge_intervals(ranges: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Union of overlapping or touching ranges per key."""
    keys = list(keys)
    edges = durable(coverage_edges(ranges, keys).withColumn("_day", time_bucket("start_unix")))
    closed = split_window(edges, keys, "_day", ["start_unix"], next_prev=("next", F.col("prev_end")))
    return closed.select(*keys, "start_unix", F.coalesce("next_prev", "last_end").alias("end_unix"))


def gaps(ranges: DataFrame, groups: DataFrame, start: int, end: int) -> DataFrame:
    """Uncovered parts of ``[start, end)`` for every group, also for groups never scanned."""
    wanted = ranges.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    edges = durable(coverage_edges(wanted))
    lead_in = edges.select(
        "group_id",
        F.greatest(F.coalesce("prev_end", F.lit(start)), F.lit(start)).cast("long").alias("start_unix"),
        F.least("start_unix", F.lit(end)).cast("long").alias("end_unix"))
    ends = edges.groupBy("group_id").agg(F.max("last_end").alias("last_end"))
    tail = groups.select("group_id").distinct().join(ends, "group_id", "left").select(
        "group_id",
        F.greatest(F.coalesce("last_end", F.lit(start)), F.lit(start)).cast("long").alias("start_unix"),
        F.lit(end).cast("long").alias("end_unix"))
    return lead_in.unionByName(tail).filter("start_unix < end_unix")


def overlap(left_start: Column, left_end: Column, right_start: Column, right_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(left_end, right_end) - F.greatest(left_start, right_start))


def covered_until(merged: DataFrame, points: DataFrame) -> DataFrame:
    """Covered seconds of a group before each point (group_id, at), all history included.

    Merged ranges do not overlap, so a point has behind it the lengths of all ranges that
    started, less what the last of them still has ahead. One ordered pass over ranges and
    points together: no range meets a point.
    """
    there = merged.select("group_id", F.col("start_unix").alias("at"), (F.col("end_unix") - F.col("start_unix")).alias("length"), F.col("end_unix").alias("reach"))
    here = points.select("group_id", "at").distinct().withColumns({"length": F.lit(0).cast("long"), "reach": F.lit(None).cast("long")})
    flow = there.unionByName(here).groupBy("group_id", "at").agg(F.sum("length").alias("length"), F.max("reach").alias("reach"))
    run = split_window(durable(flow.withColumn("_day", time_bucket("at"))), ["group_id"], "_day", ["at"],
                       total=("sum_through", F.col("length")), furthest=("max_through", F.col("reach")))
    return run.select("group_id", "at", (F.col("total") - F.greatest(F.lit(0), F.coalesce("furthest", "at") - F.col("at"))).alias("covered"))


def at_both_ends(windows: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Windows (id, group_id, from_unix, to_unix) with the values of both ends, as name_from and name_to."""
    side = lambda end: values.select("group_id", F.col("at").alias(f"{end}_unix"), *[F.col(n).alias(f"{n}_{end}") for n in names])
    return windows.join(side("from"), ["group_id", "from_unix"], "left").join(side("to"), ["group_id", "to_unix"], "left")


def window_ends(windows: DataFrame) -> DataFrame:
    return windows.select("group_id", F.explode(F.array("from_unix", "to_unix")).alias("at"))


def overlap_seconds(ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """Covered seconds of every window (id, group_id, from_unix, to_unix): what is covered
    before its end less what is covered before its start."""
    ends = at_both_ends(windows, covered_until(merge_intervals(ranges), window_ends(windows)), ["covered"])
    seconds = F.when(F.col("from_unix") < F.col("to_unix"), F.col("covered_to") - F.col("covered_from"))
    return ends.withColumn("covered_seconds", F.coalesce(seconds, F.lit(0)).cast("long")).select(*windows.columns, "covered_seconds")


def slot_grid(groups: DataFrame, start: int, end: int, slot: int) -> DataFrame:
    """Equal slots over the window, the last one clipped."""
    count = -(-(end - start) // slot)
    return groups.select("group_id").distinct().withColumn(
        "slot_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(
        "group_id", F.col("slot_index").cast("long"),
        (F.lit(start) + F.col("slot_index") * slot).cast("long").alias("start_unix"),
        F.least(F.lit(end), F.lit(start) + (F.col("slot_index") + 1) * slot).cast("long").alias("end_unix"))


def current_window(days: int, now: int) -> tuple[int, int]:
    """Window that starts at local midnight ``days - 1`` days back."""
    today = (now + LOCAL_OFFSET_SECONDS) // 86400 * 86400 - LOCAL_OFFSET_SECONDS
    return today - (days - 1) * 86400, now


def historical_window(days: int, end: int) -> tuple[int, int]:
    return end - days * 86400, end


def in_slots(merged: DataFrame, start: int, end: int, slot: int) -> DataFrame:
    """Pieces of merged intervals per slot of the window."""
    clipped = merged.withColumn("_s", F.greatest("start_unix", F.lit(start))).withColumn(
        "_e", F.least("end_unix", F.lit(end))).filter("_s < _e")
    return clipped.withColumn("slot_index", F.explode(F.sequence(
        F.floor((F.col("_s") - start) / slot).cast("long"), F.floor((F.col("_e") - 1 - start) / slot).cast("long")))).select(
        "group_id", "slot_index",
        F.greatest("_s", F.lit(start) + F.col("slot_index") * slot).alias("piece_start"),
        F.least("_e", F.lit(start) + (F.col("slot_index") + 1) * slot).alias("piece_end"))


def slot_coverage(ranges: DataFrame, start: int, end: int, slot: int) -> DataFrame:
    pieces = in_slots(merge_intervals(ranges), start, end, slot)
    return pieces.groupBy("group_id", "slot_index").agg(
        F.sum(F.col("piece_end") - F.col("piece_start")).cast("long").alias("covered_seconds"),
        F.count(F.lit(1)).alias("segment_count"),
        F.min("piece_start").alias("coverage_start"), F.max("piece_end").alias("coverage_end"))


def slot_gaps(ranges: DataFrame, groups: DataFrame, start: int, end: int, slot: int) -> DataFrame:
    """Gaps cut at slot borders: one row per (slot, uncovered piece)."""
    return in_slots(gaps(ranges, groups, start, end), start, end, slot).select(
        "group_id", "slot_index", F.col("piece_start").alias("start_unix"), F.col("piece_end").alias("end_unix"))


def digest_sum(value: Column) -> Column:
    """Order-free fingerprint of a set of texts: exact sums of two halves of their digests, and the count.

    Unlike a fold by exclusive or, equal members do not cancel.
    """
    half = lambda i: F.sum(F.conv(F.substring(F.sha2(value, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", half(0), half(1), F.count(F.lit(1)).cast("string"))


def rescan_batches(gap_rows: DataFrame) -> DataFrame:
    """Groups that miss exactly the same range share one batch.

    A batch is a set of rows (start_unix, end_unix, batch_key, group_id), however many groups
    miss the range; ``batch_key`` stands for the set of groups.
    """
    rows = gap_rows.select("start_unix", "end_unix", "group_id").distinct()
    keys = rows.groupBy("start_unix", "end_unix").agg(digest_sum(F.col("group_id")).alias("batch_key"))
    return rows.join(keys, ["start_unix", "end_unix"]).select("start_unix", "end_unix", "batch_key", "group_id")


def batch_rows(batches: DataFrame) -> DataFrame:
    """Batches given as id lists (start_unix, end_unix, group_ids), as rows."""
    ids = F.array_sort(F.array_distinct(F.transform("group_ids", lambda g: F.trim(g))))
    return batches.withColumn("batch_key", F.array_join(ids, ",")).select("start_unix", "end_unix", "batch_key", F.explode(ids).alias("group_id"))


def merge_batches(rows: DataFrame) -> DataFrame:
    """Join touching batches of the same group set, then unite groups of equal ranges."""
    joined = merge_intervals(rows.select("start_unix", "end_unix", "batch_key").distinct(), ["batch_key"])
    members = rows.select("batch_key", "group_id").distinct()
    return rescan_batches(joined.join(members, "batch_key"))


def invalid_batches(batches: DataFrame) -> DataFrame:
    """Rows a backfill plan refuses, with the reason."""
    bad_ids = F.exists("group_ids", lambda g: ~F.trim(g).rlike("^[0-9]+$"))
    reason = (F.when((F.col("start_unix") <= 0) | (F.col("start_unix") >= F.col("end_unix")), "invalid-range")
              .when(F.size("group_ids") < 1, "no-groups").when(bad_ids, "non-numeric-group"))
    return batches.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def task_id(group: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", group, start.cast("string"), end.cast("string")), 256), 1, 20)


def backfill_plan(rows: DataFrame, chunk: int = BACKFILL_CHUNK_SECONDS) -> DataFrame:
    """Tasks of at most ``chunk`` seconds that cover every batch once per group."""
    merged = merge_intervals(rows.withColumn("group_id", F.trim("group_id")))
    tasks = merged.withColumn("task_start", F.explode(F.sequence(
        F.col("start_unix"), F.col("end_unix") - 1, F.lit(chunk).cast("long")))).withColumn(
        "task_end", F.least(F.col("task_start") + chunk, F.col("end_unix")))
    return tasks.select(task_id(F.col("group_id"), F.col("task_start"), F.col("task_end")).alias("task_id"), "group_id",
                        F.col("task_start").alias("start_unix"), F.col("task_end").alias("end_unix"))


def plan_totals(tasks: DataFrame, rows: DataFrame) -> DataFrame:
    """One-row plan header. The plan id folds the task ids order-free, so the task list never
    has to meet in one place."""
    header = tasks.agg(digest_sum(F.col("task_id")).alias("_ids"), F.count(F.lit(1)).alias("task_count"), F.countDistinct("group_id").alias("group_count"),
                       F.coalesce(F.sum(F.col("end_unix") - F.col("start_unix")), F.lit(0)).cast("long").alias("total_group_seconds"))
    source = rows.agg(F.countDistinct("start_unix", "end_unix", "batch_key").alias("source_batch_count"))
    return header.withColumn("_k", F.lit(1)).join(source.withColumn("_k", F.lit(1)), "_k").select(
        F.substring(F.sha2("_ids", 256), 1, 24).alias("plan_id"), "task_count", "group_count", "total_group_seconds", "source_batch_count")


def check_plan(tasks: DataFrame, chunk: int = BACKFILL_CHUNK_SECONDS) -> DataFrame:
    """Violations of stored tasks: bad ids, bad bounds, duplicates."""
    span = F.col("end_unix") - F.col("start_unix")
    bounds = (~F.col("group_id").rlike("^[0-9]+$") | (F.col("start_unix") <= 0) | (span <= 0) | (span > chunk))
    wrong = F.col("task_id") != task_id(F.col("group_id"), F.col("start_unix"), F.col("end_unix"))
    rows = tasks.select("task_id", F.when(bounds, "bounds").when(wrong, "id-mismatch").alias("violation")).filter("violation is not null")
    twice = tasks.groupBy("task_id").count().filter("count > 1").select("task_id", F.lit("duplicate").alias("violation"))
    return rows.unionByName(twice)


def check_header(header: DataFrame, tasks: DataFrame) -> DataFrame:
    """Violations of a stored one-row plan header against its tasks."""
    real = plan_totals(tasks, tasks.select("start_unix", "end_unix", F.lit("").alias("batch_key")))
    names = ["plan_id", "task_count", "group_count", "total_group_seconds"]
    both = header.withColumn("_k", F.lit(1)).join(real.select(*[F.col(n).alias(f"_{n}") for n in names], F.lit(1).alias("_k")), "_k")
    found = [F.when(~F.col(n).eqNullSafe(F.col(f"_{n}")), F.lit(n)) for n in names]
    found += [F.when(F.coalesce(F.col("source_batch_count"), F.lit(0)) < 1, F.lit("source_batch_count")), F.when(F.col("_task_count") == 0, F.lit("empty"))]
    return both.select(F.explode(F.array_compact(F.array(*found))).alias("violation"))


def pending_tasks(tasks: DataFrame, state: DataFrame) -> DataFrame:
    """Tasks not completed yet. ``state``: task_id, status, message."""
    return tasks.join(state.filter("status = 'done'"), "task_id", "left_anti")


def advance_state(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fold attempt outcomes (task_id, attempt, status, message) into the state: a success
    is final and clears the failure, otherwise the latest failure message stays."""
    known = state.select("task_id", F.lit(-1).cast("long").alias("attempt"), "status", "message")
    every = known.unionByName(outcomes.select("task_id", F.col("attempt").cast("long"), "status", "message"))
    done = F.max((F.col("status") == "done").cast("int")) == 1
    return every.groupBy("task_id").agg(
        F.when(done, "done").otherwise("failed").alias("status"),
        F.when(done, "").otherwise(F.max_by("message", "attempt")).alias("message"))


def progress(tasks: DataFrame, state: DataFrame) -> DataFrame:
    joined = tasks.join(state.select("task_id", "status"), "task_id", "left")
    done = F.col("status") == "done"
    seconds = F.col("end_unix") - F.col("start_unix")
    return joined.agg(
        F.count(F.lit(1)).alias("total_tasks"), F.count(F.when(done, 1)).alias("completed_tasks"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed_tasks"),
        F.coalesce(F.sum(F.when(done, seconds)), F.lit(0)).cast("long").alias("completed_seconds"))


def coverage_breaks(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Consecutive message times of a group with some range end strictly between them.

    Works on distinct seconds: an end lies between two messages exactly when the latest
    end before the later one is after the earlier one.
    """
    seconds = messages.select("group_id", "sent_at").distinct()
    ends = merge_intervals(ranges).select("group_id", F.col("end_unix").alias("sent_at"), F.lit(1).alias("_end"))
    flow = seconds.withColumn("_end", F.lit(0)).unionByName(ends).groupBy("group_id", "sent_at").agg(
        F.max("_end").alias("_end"), F.min("_end").alias("_msg")).withColumn("_day", time_bucket("sent_at"))
    marked = split_window(durable(flow), ["group_id"], "_day", ["sent_at"],
                          prev_end=("max_before", F.when(F.col("_end") == 1, F.col("sent_at"))),
                          prev_message=("max_before", F.when(F.col("_msg") == 0, F.col("sent_at"))))
    return marked.filter((F.col("_msg") == 0) & (F.col("prev_end") > F.col("prev_message"))).select(
        "group_id", F.col("prev_message").alias("before_unix"), F.col("sent_at").alias("after_unix"))


def inside_coverage(points: DataFrame, ranges: DataFrame, point: str = "file_mtime") -> DataFrame:
    """Flag points inside any scanned range of any group, both ends included.

    Union and running maximum instead of a join: a point is covered when the furthest end
    of the ranges starting at or before it has not passed.
    """
    everywhere = ranges.groupBy("start_unix").agg(F.max("end_unix").alias("end_unix"))
    seconds = points.select(F.col(point).alias("start_unix")).distinct()
    flow = everywhere.unionByName(seconds.withColumn("end_unix", F.lit(None).cast("long"))).groupBy("start_unix").agg(
        F.max("end_unix").alias("end_unix")).withColumn("_day", time_bucket("start_unix"))
    reached = split_window(durable(flow), [], "_day", ["start_unix"], reach=("max_through", F.col("end_unix")))
    covered = reached.filter((F.col("reach") >= F.col("start_unix")) & (F.col("start_unix") > 0)).select(
        F.col("start_unix").alias(point), F.lit(True).alias("inside"))
    return points.join(covered, point, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def slots_touching(slots: DataFrame, spans: DataFrame, width: int = 86400) -> DataFrame:
    """Slots that share time with a span (id, group_id, from_unix, to_unix)."""
    left = slots.withColumn("_bucket", F.explode(F.sequence(
        time_bucket("start_unix", width), time_bucket(F.col("end_unix") - 1, width))))
    right = spans.filter("from_unix < to_unix").withColumn("_bucket", F.explode(F.sequence(
        time_bucket("from_unix", width), time_bucket(F.col("to_unix") - 1, width))))
    return left.join(right, ["group_id", "_bucket"]).filter(
        (F.col("from_unix") < F.col("end_unix")) & (F.col("to_unix") > F.col("start_unix"))).select(
        "id", "group_id", "slot_index").distinct()


def compare_collections(left: DataFrame, right: DataFrame, key: str = "content_key") -> DataFrame:
    """Every key with the side it occurs on: both, left or right."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.select(key, F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def duplicate_runs(runs: DataFrame) -> DataFrame:
    """Runs repeating an earlier listed run: same groups, range, text and media counts."""
    signature = ["_groups", "start_unix", "end_unix", "text_messages", "media_messages"]
    keyed = runs.withColumn("_groups", F.array_join(F.array_sort("group_ids"), ","))
    first = keyed.groupBy(*signature).agg(F.min_by("run_id", "list_order").alias("run_id")).select("run_id")
    return runs.join(first.withColumn("_first", F.lit(True)), "run_id", "left").withColumn(
        "is_duplicate", F.col("_first").isNull()).drop("_first")
