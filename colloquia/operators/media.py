"""Media ownership, events, propagation, comparison and file resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import safe_name
from colloquia.functions.values import bare_row_id, local_day, to_local
from colloquia.operators.content import block_starts
from colloquia.operators.ordered import lookup, ordinal, top_per_key

EVENT_GAP_SECONDS = 1200


def scan_messages(raw: DataFrame, groups: DataFrame, start: int, end: int, cap: int) -> DataFrame:
    """Rows of the wanted groups inside the window, newest first up to the row budget.

    ``truncated`` marks groups with more rows in the window than the budget; older history
    neither counts nor is read. ``raw`` carries msg_seq.
    """
    inside = raw.filter((F.col("sent_at") >= start) & (F.col("sent_at") < end)).join(groups.select("group_id").distinct(), "group_id", "left_semi")
    counted = inside.groupBy("group_id").agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return top_per_key(inside, ["group_id"], [F.col("msg_seq").desc()], cap, "scan_rank").join(counted, "group_id")


def scan_outcome(groups: DataFrame, start: int) -> DataFrame:
    """One coverage verdict per scan: any incomplete group means nothing counts as covered.
    ``groups``: scan_id, group_id, truncated, failed."""
    folded = groups.groupBy("scan_id").agg(F.bool_or("truncated").alias("t"), F.bool_or("failed").alias("f"))
    done = ~(F.col("t") | F.col("f"))
    return folded.select("scan_id", F.when(done, "complete").when(F.col("f"), "aborted").otherwise("scan-limit").alias("stop_reason"),
                         (F.col("t") & ~F.col("f")).alias("scan_truncated"), F.col("f").alias("scan_aborted"),
                         F.when(done, F.lit(start)).cast("long").alias("covered_from"))


def owned_refs(refs: DataFrame) -> DataFrame:
    """Flag refs owned by the earliest message of their (group, hash); emoji and hashless
    refs are always owned.

    Owners are found by a map-side reduced minimum and matched back on the owner's own row,
    so copies of one picture never meet in one task.
    """
    tracked = refs.filter((F.col("kind") != "emoji") & F.col("hash").isNotNull())
    owner = tracked.groupBy("group_id", "hash").agg(F.min(F.struct("sent_at", "row_num")).alias("o")).select(
        "group_id", "hash", F.col("o.sent_at").alias("sent_at"), F.col("o.row_num").alias("row_num"), F.lit(True).alias("_first"))
    joined = refs.join(owner, ["group_id", "hash", "sent_at", "row_num"], "left")
    return joined.withColumn("owned", (F.col("kind") == "emoji") | F.col("hash").isNull() | F.coalesce("_first", F.lit(False))).drop("_first")


def quote_links(flagged: DataFrame) -> DataFrame:
    """Image hashes a message re-embeds without owning them, one row per (message, hash)."""
    return flagged.filter(~F.col("owned") & (F.col("kind") == "image")).select("group_id", "row_id", F.col("hash").alias("quoted_hash")).distinct()


def first_sighting(refs: DataFrame) -> DataFrame:
    """Earliest message per image hash, ties by input order."""
    images = refs.filter((F.col("kind") == "image") & (F.length("hash") == 32)).withColumn("hash", F.lower("hash"))
    return images.groupBy("hash").agg(F.min_by(F.struct("group_id", "row_id", "sent_at", "speaker", "sender"), F.struct("sent_at", "input_order")).alias("m")).select("hash", "m.*")


def image_owners(refs: DataFrame) -> DataFrame:
    """First poster of every image over all groups, in export order."""
    return refs.filter((F.col("kind") == "image") & F.col("hash").isNotNull()).groupBy("hash").agg(
        F.min_by(F.struct("group_id", "row_id", "sent_at", "sender", "speaker", "input_order"), F.struct("sent_at", "input_order")).alias("o")).select("hash", "o.*")


def flag_duplicates(index: DataFrame) -> DataFrame:
    """``dup`` is false for the newest file of each (group, content); first wins ties."""
    primary = index.groupBy("group_id", "content_key").agg(
        F.max_by("web_path", F.struct(F.col("sent_at"), (-F.col("input_order")).alias("o"))).alias("web_path")).select("web_path", F.lit(False).alias("dup"))
    return index.join(primary, "web_path", "left").withColumn("dup", F.coalesce("dup", F.lit(True)))


def with_events(index: DataFrame, gap: int = EVENT_GAP_SECONDS) -> DataFrame:
    """Add each item's event (group, first second of the run it belongs to)."""
    starts = block_starts(index.select("group_id", "sent_at").distinct(), ["group_id"], gap)
    return index.join(starts.withColumnRenamed("block_start", "event_start"), ["group_id", "sent_at"])


def media_events(index: DataFrame, gap: int = EVENT_GAP_SECONDS) -> DataFrame:
    """Event summaries: span, counts per kind, bytes, people, id from the first item."""
    items = with_events(index, gap)
    evidence = F.coalesce(F.nullif("row_id", F.lit("")), F.nullif("content_key", F.lit("")), F.col("web_path"))
    reduced = items.groupBy("group_id", "event_start", "speaker", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.max("sent_at").alias("last"), F.min(F.struct("sent_at", "input_order", evidence.alias("e"))).alias("first"))
    return reduced.groupBy("group_id", "event_start").agg(
        F.max("last").alias("end_unix"), F.sum("n").alias("item_count"), F.sum(F.when(F.col("kind") == "image", F.col("n")).otherwise(0)).alias("image_count"),
        F.sum(F.when(F.col("kind") == "video", F.col("n")).otherwise(0)).alias("video_count"), F.sum("b").alias("total_bytes"),
        F.count_distinct("speaker").alias("speaker_count"), F.min("first")["e"].alias("_e")).select(
        F.concat_ws(":", F.lit("event"), "group_id", "_e", F.col("event_start").cast("string")).alias("event_id"),
        "group_id", F.col("event_start").alias("start_unix"), "end_unix", "item_count", "image_count", "video_count", "total_bytes", "speaker_count")


def event_speakers(index: DataFrame, gap: int = EVENT_GAP_SECONDS) -> DataFrame:
    return with_events(index, gap).select("group_id", F.col("event_start").alias("start_unix"), "speaker").distinct()


def events_for_matches(index: DataFrame, matched: DataFrame, gap: int = EVENT_GAP_SECONDS) -> DataFrame:
    """Events holding a matched item, built from all items so their ids stay stable."""
    hit = with_events(index, gap).join(matched.select("web_path").distinct(), "web_path", "left_semi").select(
        "group_id", F.col("event_start").alias("start_unix")).distinct()
    return media_events(index, gap).join(hit, ["group_id", "start_unix"], "left_semi")


def propagation(index: DataFrame) -> DataFrame:
    """Contents posted more than once, with reach and span; copies are counted map-side."""
    reduced = index.groupBy("content_key", "group_id", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.min("sent_at").alias("a"), F.max("sent_at").alias("b"))
    return reduced.groupBy("content_key").agg(
        F.sum("n").alias("occurrences"), F.count_distinct("group_id").alias("group_count"), F.count_distinct("speaker").alias("speaker_count"),
        F.min("a").alias("first_unix"), F.max("b").alias("last_unix")).filter("occurrences > 1")


def chain_occurrences(index: DataFrame) -> DataFrame:
    """Numbered occurrences of every repeated content, oldest first."""
    repeated = propagation(index).select("content_key")
    chained = index.join(repeated, "content_key", "left_semi").select("content_key", "sent_at", "group_id", "web_path")
    return ordinal(chained, ["content_key"], ["sent_at", "group_id", "web_path"], "position")


def media_filter(index: DataFrame, group: str | None = None, kind: str | None = None, speaker: str | None = None,
                 start: int | None = None, end: int | None = None, primary_only: bool = True) -> DataFrame:
    kept = index.filter(~F.col("dup")) if primary_only else index
    for condition in [None if group is None else F.col("group_id") == group, None if kind is None else F.col("kind") == kind,
                      None if speaker is None else F.contains(F.lower("speaker"), F.lit(speaker.lower())),
                      None if start is None else F.col("sent_at") >= start, None if end is None else F.col("sent_at") < end]:
        if condition is not None:
            kept = kept.filter(condition)
    return kept


def media_sort(index: DataFrame, mode: str) -> DataFrame:
    order = {"time-desc": [F.col("sent_at").desc()], "time-asc": [F.col("sent_at").asc()], "size-desc": [F.col("bytes").desc(), F.col("sent_at").desc()]}[mode]
    return index.orderBy(*order, "input_order")


def media_summary(index: DataFrame) -> DataFrame:
    reduced = index.groupBy("group_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.min("sent_at").alias("a"), F.max("sent_at").alias("z"))
    return reduced.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("item_count"), F.count_distinct("group_id").alias("group_count"), F.count_distinct("speaker").alias("speaker_count"),
                       F.min("a").alias("first_unix"), F.max("z").alias("last_unix"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"))


def by_day(index: DataFrame) -> DataFrame:
    return index.groupBy(local_day("sent_at").alias("day")).agg(F.count(F.lit(1)).alias("item_count"), F.sum("bytes").alias("total_bytes"))


def message_media(messages: DataFrame, index: DataFrame) -> DataFrame:
    """Files of media messages: all with the same row id, else the n-th file of the same
    group and second for the n-th such message, else the first of that second."""
    media = messages.filter("is_media = 1").select("group_id", F.col("row_id").alias("message_row"), bare_row_id("row_id").alias("row_id"), "sent_at")
    files = index.select("group_id", "row_id", "sent_at", "web_path", "input_order")
    exact = media.join(files.select("group_id", "row_id", "web_path"), ["group_id", "row_id"]).select("group_id", "message_row", "web_path", F.lit("row").alias("via"))
    rest = media.join(files.select("group_id", "row_id").distinct(), ["group_id", "row_id"], "left_anti")
    second = ["group_id", "sent_at"]
    waiting = ordinal(rest, second, ["message_row"], "n")
    listed = ordinal(files.join(rest.select(*second).distinct(), second, "left_semi"), second, ["input_order"], "n").select(*second, "n", "web_path")
    first = listed.filter("n = 1").select("group_id", "sent_at", F.col("web_path").alias("_first"))
    timed = waiting.join(listed, ["group_id", "sent_at", "n"], "left").join(first, ["group_id", "sent_at"]).select(
        "group_id", "message_row", F.coalesce("web_path", "_first").alias("web_path"), F.lit("time").alias("via"))
    return exact.unionByName(timed)


def media_names(refs: DataFrame, names: DataFrame) -> DataFrame:
    """Target names with a running index per run. The index is a distributed position."""
    numbered = ordinal(refs, ["run_id"], ["sent_at", "input_order"], "run_index").join(names, "group_id", "left")
    group = safe_name(F.coalesce(F.nullif("name", F.lit("")), F.col("group_id")))
    digits = F.when(F.col("run_index") < 10000, F.lpad(F.col("run_index").cast("string"), 4, "0")).otherwise(F.col("run_index").cast("string"))
    stamp = F.regexp_replace(to_local("sent_at"), "[-: ]", "")
    extension = F.regexp_extract("file_name", r"(\.[^.]+)$", 1)
    return numbered.select("run_id", "run_index", F.concat(F.concat_ws("_", digits, stamp, group, safe_name("speaker")), extension).alias("target_name"))


def resolve_sources(refs: DataFrame, files: DataFrame, formats: list[str]) -> DataFrame:
    """Best source file per reference: exact path, then hash, then file name; inside a tier
    allowed extensions first, then the largest. ``files``: path, size."""
    name = F.lower(F.element_at(F.split("path", r"[\\/]"), -1))
    known = files.select("path", "size", name.alias("name"), F.nullif(F.regexp_extract(name, "[a-f0-9]{32}", 0), F.lit("")).alias("hash"),
                         F.lower(F.element_at(F.split("path", r"\."), -1)).isin(formats).alias("allowed"))
    better = F.struct("allowed", "size", "path")
    by_hash = known.filter("hash is not null").groupBy("hash").agg(F.max_by("path", better).alias("_by_hash"))
    by_name = known.groupBy(F.col("name").alias("_name")).agg(F.max_by("path", better).alias("_by_name"))
    by_path = known.select(F.col("path").alias("local_path"), F.col("path").alias("_by_path")).distinct()
    named = refs.withColumn("hash", F.lower("hash")).withColumn("_name", F.lower("file_name"))
    joined = lookup(lookup(lookup(named, "local_path", by_path), "hash", by_hash), "_name", by_name)
    via = F.when(F.col("_by_path").isNotNull(), "path").when(F.col("_by_hash").isNotNull(), "hash").when(F.col("_by_name").isNotNull(), "name").otherwise("none")
    return joined.withColumn("source_path", F.coalesce("_by_path", "_by_hash", "_by_name")).withColumn("via", via).drop("_by_path", "_by_hash", "_by_name", "_name")


def original_index(files: DataFrame) -> DataFrame:
    """First original per hash in directory order."""
    name = F.lower(F.element_at(F.split("path", r"[\\/]"), -1))
    hashed = files.withColumn("hash", F.regexp_extract(name, r"^([a-f0-9]{32})\.", 1)).filter("hash <> ''")
    return hashed.groupBy("hash").agg(F.min("path").alias("path"))


def normalize_review(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid reviews (event_id, status, favorite, note) and the refused rows with a reason."""
    reason = F.when(~F.coalesce(F.col("status").isin(fv.REVIEW_STATUSES), F.lit(False)), "status").when(F.col("note").isNull(), "note")
    judged = rows.withColumn("reason", reason)
    good = judged.filter("reason is null").withColumn("favorite", F.coalesce("favorite", F.lit(False))).withColumn("note", F.substring(F.trim("note"), 1, 500)).drop("reason")
    return good, judged.filter("reason is not null")


def upsert_reviews(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Fold patches (event_id, seq, status?, favorite?, note?) over the stored reviews; the
    latest given value of each field wins, defaults fill the rest."""
    rows = current.select("event_id", F.lit(-1).cast("long").alias("seq"), "status", "favorite", "note").unionByName(patches.select("event_id", F.col("seq").cast("long"), "status", "favorite", "note"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("event_id").agg(F.coalesce(newest("status"), F.lit("unreviewed")).alias("status"),
                                        F.coalesce(newest("favorite"), F.lit(False)).alias("favorite"), F.coalesce(newest("note"), F.lit("")).alias("note"))


def review_filter(events: DataFrame, reviews: DataFrame, mode: str) -> DataFrame:
    joined = events.join(reviews.select("event_id", "status", "favorite"), "event_id", "left")
    status = F.coalesce("status", F.lit("unreviewed"))
    keep: Column = {"all": F.lit(True), "favorite": F.coalesce("favorite", F.lit(False))}.get(mode, status == mode)
    return joined.filter(keep).drop("status", "favorite")


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """One text line per manifest row: time, speaker, kind and where the file went."""
    target = F.coalesce(F.nullif("copied_path", F.lit("")), F.col("url"), F.lit("missing"))
    return manifest.select("row_id", F.concat(F.lit("["), to_local("sent_at"), F.lit("] "), F.col("speaker"), F.lit(" "), F.col("kind"), F.lit(": "), target).alias("line"))
