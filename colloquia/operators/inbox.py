"""Group lists, unread counts, paging and search over the message table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquia.operators.activity import coverage_health
from colloquia.operators.intervals import current_window, gaps
from colloquia.operators.ordered import DAY_SECONDS, top_per_key
from colloquia.session import durable

PAGE_DEFAULT, PAGE_MAX = 300, 500
BUBBLE_GAP_SECONDS = 300
RESUME_OVERLAP_SECONDS, RESUME_MAX_DAYS, RESUME_FALLBACK_HOURS = 600, 30, 26


def stored_groups(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Counts first, names after: the join sees one row per group."""
    counts = messages.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.min("sent_at").alias("first_unix"), F.max("sent_at").alias("last_unix"))
    return counts.join(names, "group_id", "left").select(
        "group_id", F.coalesce("name", F.lit("")).alias("name"), "message_count", "first_unix", "last_unix")


def _marked(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Flag messages after their group's read mark; a missing mark is (0, '').

    Marks hold one row per group, so Spark broadcasts them while they are small and
    splits hot groups by AQE beyond that.
    """
    mark = marks.select("group_id", F.col("sent_at").alias("_at"), F.col("row_id").alias("_row"))
    later = F.struct("sent_at", "row_id") > F.struct(F.coalesce("_at", F.lit(0).cast("long")).alias("sent_at"), F.coalesce("_row", F.lit("")).alias("row_id"))
    return messages.join(mark, "group_id", "left").withColumn("_later", later).drop("_at", "_row")


def unread(messages: DataFrame, marks: DataFrame) -> DataFrame:
    return _marked(messages.select("group_id", "sent_at", "row_id"), marks).groupBy("group_id").agg(
        F.sum(F.col("_later").cast("long")).alias("unread_count"))


def coverage_ends(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("group_id").agg(F.max("end_unix").alias("coverage_end"))


def latest_message(messages: DataFrame) -> DataFrame:
    wanted = F.struct("row_id", "sent_at", "speaker", "is_media", "media_kinds")
    return messages.groupBy("group_id").agg(F.max_by(wanted, F.struct("sent_at", "row_id")).alias("m")).select(
        "group_id", F.col("m.row_id").alias("last_row_id"), F.col("m.sent_at").alias("last_unix"), F.col("m.speaker").alias("last_speaker"),
        F.col("m.is_media").alias("last_is_media"), F.col("m.media_kinds").alias("last_media_kinds"))


def inbox(messages: DataFrame, names: DataFrame, marks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Everything the group list shows, from one pass over the messages."""
    last = F.max_by(F.struct("row_id", "speaker", "is_media", "media_kinds"), F.struct("sent_at", "row_id"))
    folded = _marked(messages.select("group_id", "sent_at", "row_id", "speaker", "is_media", "media_kinds"), marks).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.min("sent_at").alias("first_unix"), F.max("sent_at").alias("last_unix"),
        F.sum(F.col("_later").cast("long")).alias("unread_count"), last.alias("m"))
    return folded.join(names, "group_id", "left").join(coverage_ends(ranges), "group_id", "left").select(
        "group_id", F.coalesce("name", F.lit("")).alias("name"), "message_count", "first_unix", "last_unix", "unread_count", "coverage_end",
        F.col("m.row_id").alias("last_row_id"), F.col("m.speaker").alias("last_speaker"), F.col("m.is_media").alias("last_is_media"), F.col("m.media_kinds").alias("last_media_kinds"))


def resume_point(ranges: DataFrame, targets: DataFrame, now: int) -> DataFrame:
    """Where the next scan starts: the earliest coverage end of the targets, not older than
    30 days, less the overlap; 26 hours back when no target was ever scanned."""
    ends = targets.select("group_id").distinct().join(coverage_ends(ranges).filter("coverage_end > 0"), "group_id", "left")
    folded = ends.agg(F.min("coverage_end").alias("m"), F.count(F.when(F.col("coverage_end").isNull(), 1)).alias("unscanned_groups"))
    known = F.greatest(F.col("m"), F.lit(now - RESUME_MAX_DAYS * 86400)) - RESUME_OVERLAP_SECONDS
    return folded.select(F.coalesce(F.when(F.col("m").isNotNull(), known), F.lit(now - RESUME_FALLBACK_HOURS * 3600)).cast("long").alias("start_unix"),
                         F.lit(now).cast("long").alias("end_unix"), "unscanned_groups")


def automation_coverage(watch: DataFrame, ranges: DataFrame) -> DataFrame:
    joined = watch.select("group_id").join(coverage_ends(ranges), "group_id", "left")
    missing = F.count(F.when(F.col("coverage_end").isNull(), 1))
    return joined.agg(F.count(F.lit(1)).alias("target_groups"), missing.alias("unscanned_groups"),
                      F.when(missing == 0, F.min("coverage_end")).alias("coverage_through"))


def watch_health(watch: DataFrame, messages: DataFrame, ranges: DataFrame, marks: DataFrame, now: int, days: int = 7) -> DataFrame:
    start, end = current_window(days, now)
    lost = gaps(ranges, watch, start, end).groupBy("group_id").agg(
        F.sum(F.col("end_unix") - F.col("start_unix")).alias("missing_seconds"), F.min("start_unix").alias("earliest_gap_unix"))
    mine = messages.join(watch.select("group_id").distinct(), "group_id", "left_semi")
    seen = _marked(mine.select("group_id", "sent_at", "row_id"), marks).groupBy("group_id").agg(
        F.max("sent_at").alias("latest_message_unix"), F.sum(F.col("_later").cast("long")).alias("unread_count"))
    missing = F.coalesce("missing_seconds", F.lit(0))
    return (watch.join(lost, "group_id", "left").join(coverage_ends(ranges), "group_id", "left").join(seen, "group_id", "left").select(
            "group_id", "name", F.round((end - start - missing) / (end - start), 6).alias("coverage_ratio"), missing.cast("long").alias("missing_seconds"),
            "earliest_gap_unix", F.col("coverage_end").alias("latest_scan_unix"), "latest_message_unix",
            F.coalesce("unread_count", F.lit(0)).cast("long").alias("unread_count")))


def group_activity(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    last = messages.groupBy("group_id").agg(F.max("sent_at").alias("latest_message_unix"))
    return coverage_ends(ranges).join(last, "group_id", "left").select("group_id", F.col("coverage_end").alias("latest_scan_unix"), "latest_message_unix")


def unread_window(targets: DataFrame, marks: DataFrame, now: int) -> DataFrame:
    """First second of the unread view: half an hour before the mark, else two days back."""
    return targets.select("group_id").join(marks.select("group_id", "sent_at"), "group_id", "left").select(
        "group_id", F.coalesce(F.col("sent_at") - 1800, F.lit(now - 48 * 3600)).cast("long").alias("from_unix"))


def search_filter(term: str, *columns: str) -> Column:
    """Case-insensitive substring on any of the columns; wildcards in the term are dropped."""
    cleaned = term.strip().replace("%", "").replace("_", "").lower()
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.contains(F.lower(F.col(column)), F.lit(cleaned))
    return hit


def search_messages(messages: DataFrame, term: str) -> DataFrame:
    return messages.filter(search_filter(term, "text", "speaker"))


def clamp_page(limit: int | None) -> int:
    return limit if isinstance(limit, int) and 0 < limit <= PAGE_MAX else PAGE_DEFAULT


def page(messages: DataFrame, limit: int | None = None, after: tuple[int, str] | None = None, before: tuple[int, str] | None = None) -> DataFrame:
    """Keyset page on (sent_at, row_id) with ``has_more`` for the paged direction."""
    size = clamp_page(limit)
    at = lambda mark: F.struct(F.lit(mark[0]).cast("long").alias("sent_at"), F.lit(mark[1]).alias("row_id"))
    here = F.struct("sent_at", "row_id")
    if before is not None:
        rows, order = messages.filter(here < at(before)), [F.col("sent_at").desc(), F.col("row_id").desc()]
    else:
        rows = messages if after is None else messages.filter(here > at(after))
        order = [F.col("sent_at").asc(), F.col("row_id").asc()]
    fetched = rows.orderBy(*order).limit(size + 1)  # at most 501 rows from here on
    ranked = top_per_key(fetched, [], order, size + 1, "_n")
    flagged = ranked.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size)
    return flagged.filter(F.col("_n") <= size).drop("_n").orderBy("sent_at", "row_id")


def selection(messages: DataFrame, group: str, start: int, end: int, limit: int = 500) -> DataFrame:
    """Text of a hand-picked span: end inclusive, oldest rows first, limit before the text filter."""
    span = messages.filter((F.col("group_id") == group) & (F.col("sent_at") >= start) & (F.col("sent_at") < end + 1))
    return span.orderBy("sent_at", "row_id").limit(limit).filter((F.col("is_media") == 0) & (F.trim("text") != ""))


LOCAL_SHIFT = 8 * 3600


def _segments_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Breaks of ordered rows against the row before them in the same partition and group.

    The first row of a group in the partition is a ``head`` and gets no break of its own;
    ``bubble`` counts the breaks since it.
    """
    held, count = None, 0
    for batch in batches:
        rows = batch.to_pandas()
        if rows.empty:
            continue
        at, marks = rows["sent_at"].to_numpy(np.int64), rows["mark_at"].to_numpy(float)
        who, group = rows["speaker"].to_numpy(object), rows["group_id"].to_numpy(object)
        last_group, last_at, last_who = held or (None, 0, None)
        before = np.concatenate([[last_at], at[:-1]])
        follows = np.concatenate([[last_group], group[:-1]]) == group
        day = follows & ((at + LOCAL_SHIFT) // DAY_SECONDS != (before + LOCAL_SHIFT) // DAY_SECONDS)
        divider = follows & (at > marks) & (before <= marks)  # no mark: not a number, so no divider
        other = np.concatenate([[last_who], who[:-1]]) != who
        bubble = follows & (day | divider | other | (at - before >= BUBBLE_GAP_SECONDS))
        run = np.cumsum(bubble)
        start = np.maximum.accumulate(np.where(follows, -1, np.arange(len(rows))))
        number = run + count
        inside = start >= 0
        number[inside] = run[inside] - run[start[inside]]
        held, count = (group[-1], at[-1], who[-1]), int(number[-1])
        flags = {"head": ~follows, "new_day": day, "unread_divider": divider, "new_bubble": bubble, "bubble": number.astype(np.int64)}
        for name, values in flags.items():
            batch = batch.append_column(name, pa.array(values))
        yield batch


def chat_segments(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Rendering breaks of a chat: new day, unread divider, new bubble, bubble number.

    Needs the full row order, so rows are range-partitioned evenly over (group, time, row), sorted
    and cut once. A pass over the sorted partitions settles all rows but the first of each
    (partition, group); one summary row for each of those (first row, last row, breaks between)
    settles the rest. Rows are not shuffled again. Messages without a group or time are left out;
    two missing speakers are alike.
    """
    order = ["group_id", "sent_at", "row_id"]
    marked = messages.select(*order, "speaker").filter("group_id IS NOT NULL AND sent_at IS NOT NULL").join(
        marks.select("group_id", F.col("sent_at").alias("mark_at")), "group_id", "left")
    cut = durable(marked.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    fields = "group_id string, sent_at long, row_id string, speaker string, mark_at long, _part int, head boolean, new_day boolean, unread_divider boolean, new_bubble boolean, bubble long"
    rows = cut.mapInArrow(_segments_inside, fields)
    ends = F.struct("sent_at", "speaker")
    place = F.struct("sent_at", "row_id")
    parts = rows.groupBy("group_id", "_part").agg(
        F.min("sent_at").alias("at"), F.min_by("speaker", place).alias("who"), F.max("mark_at").alias("mark_at"),
        F.max_by(ends, place).alias("last"), F.max("bubble").alias("breaks"))
    across = Window.partitionBy("group_id").orderBy("_part")
    local_day = lambda c: F.floor((c + LOCAL_SHIFT) / DAY_SECONDS)
    linked = parts.withColumn("prev", F.lag("last").over(across))
    first = F.col("prev").isNull()
    day = first | (local_day(F.col("at")) != local_day(F.col("prev.sent_at")))
    divider = F.coalesce((F.col("at") > F.col("mark_at")) & (first | (F.col("prev.sent_at") <= F.col("mark_at"))), F.lit(False))
    bubble = day | divider | ~F.col("prev.speaker").eqNullSafe(F.col("who")) | (F.col("at") - F.col("prev.sent_at") >= BUBBLE_GAP_SECONDS)
    heads = linked.select("group_id", "_part", day.alias("_day"), divider.alias("_divider"), bubble.alias("_bubble"), "breaks")
    through = F.sum(F.col("_bubble").cast("long")).over(across) + F.coalesce(F.sum("breaks").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = heads.withColumn("_offset", through).drop("breaks")
    return rows.join(offsets, ["group_id", "_part"]).select(
        "group_id", "row_id", "sent_at", *[F.when(F.col("head"), F.col(mine)).otherwise(F.col(c)).alias(c) for c, mine in (
            ("new_day", "_day"), ("unread_divider", "_divider"), ("new_bubble", "_bubble"))], (F.col("bubble") + F.col("_offset")).alias("bubble"))


def group_sections(groups: DataFrame, health: DataFrame, watch: DataFrame, activity: DataFrame, recent: int = 20) -> DataFrame:
    """Group picker: gaps, watched, recently scanned, all; every group in its first section."""
    latest = activity.orderBy(F.col("latest_scan_unix").desc(), "group_id").limit(recent)
    part = lambda df, n, s: df.select("group_id", F.lit(n).cast("long").alias("section_rank"), F.lit(s).alias("section"))
    listed = (part(health.filter("missing_seconds > 0"), 0, "gaps").unionByName(part(watch, 1, "watched"))
              .unionByName(part(latest, 2, "recent")).unionByName(part(groups, 3, "all")))
    known = listed.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    return known.groupBy("group_id").agg(F.min(F.struct("section_rank", "section")).alias("s")).select("group_id", "s.section_rank", "s.section")


def search_groups(names: DataFrame, term: str, limit: int = 80) -> DataFrame:
    hit = F.contains(F.col("group_id"), F.lit(term)) | F.contains(F.lower("name"), F.lit(term.lower()))
    return names.filter(hit).orderBy("group_id").limit(limit)
