"""Keyed table maintenance: every rule is a function of (stored rows, new rows)."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import light_clean, tags_from_prompt
from colloquia.functions.values import run_created


def to_messages(text: DataFrame, media: DataFrame) -> DataFrame:
    """Union of text and media rows; media row ids get the ``m`` prefix."""
    columns = ["group_id", "row_id", "sent_at", "speaker", "text", "is_media", "media_kinds", "speaker_uin"]
    left = text.withColumn("is_media", F.lit(0).cast("long")).withColumn("media_kinds", F.lit(""))
    right = media.withColumn("row_id", F.concat(F.lit("m"), "row_id")).withColumn("is_media", F.lit(1).cast("long"))
    return left.select(*columns).unionByName(right.select(*columns))


def ingest_messages(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """New rows to append: blank texts dropped, blank media kept, first of a repeated key,
    and nothing that is already stored."""
    clean = delta.withColumn("text", F.when(F.col("is_media") == 0, light_clean("text")).otherwise(F.col("text"))).filter("is_media = 1 or text <> ''")
    once = clean.groupBy("group_id", "row_id").agg(F.min_by(F.struct(*[c for c in clean.columns if c not in ("group_id", "row_id")]), "input_order").alias("r")).select("group_id", "row_id", "r.*")
    return once.join(stored.select("group_id", "row_id"), ["group_id", "row_id"], "left_anti")


def append_coverage(scans: DataFrame) -> DataFrame:
    """Scan windows as coverage rows. ``has_covered`` tells an absent field (whole window)
    from a null one (nothing covered)."""
    start = F.when(F.col("has_covered"), F.col("covered_from")).otherwise(F.col("start_unix"))
    return scans.select("group_id", start.alias("start_unix"), "end_unix", "run_id").filter("start_unix is not null and end_unix is not null and start_unix < end_unix")


def upsert_names(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Latest non-blank name per group; a blank one only fills an empty place."""
    rows = stored.select("group_id", "name", F.lit(-1).cast("long").alias("seq")).unionByName(delta.select("group_id", "name", F.col("seq").cast("long")))
    return rows.groupBy("group_id").agg(F.coalesce(F.max_by("name", F.when(F.col("name") != "", F.col("seq"))), F.lit("")).alias("name"))


def advance_marks(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Read marks only move forward on (sent_at, row_id)."""
    columns = ["group_id", "sent_at", "row_id"]
    rows = stored.select(*columns).unionByName(delta.select(*columns))
    return rows.groupBy("group_id").agg(F.max(F.struct("sent_at", "row_id")).alias("m")).select("group_id", "m.*")


def marks_to_latest(messages: DataFrame, stored: DataFrame) -> DataFrame:
    latest = messages.groupBy("group_id").agg(F.max(F.struct("sent_at", "row_id")).alias("m")).select("group_id", "m.*")
    return advance_marks(stored, latest)


def upsert_images(stored: DataFrame, delta: DataFrame, order: str = "parsed_at") -> DataFrame:
    """Latest record per hash replaces the stored one and clears its missing flag; the
    durable path stays as it was, as do stored columns that the delta lacks."""
    fields = [c for c in delta.columns if c not in ("hash", "object_path", "file_missing")]
    fresh = delta.groupBy("hash").agg(F.max_by(F.struct(*fields), order).alias("n"))
    merged = stored.join(fresh, "hash", "full")
    pick = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    kept = [c for c in stored.columns if c not in ("hash", "file_missing", "object_path", *fields)]
    return merged.select("hash", *pick, *kept, F.when(F.col("n").isNotNull(), 0).otherwise(F.col("file_missing")).cast("long").alias("file_missing"), F.coalesce("object_path", F.lit("")).alias("object_path"))


def replace_children(stored: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """Child rows of re-parsed assets are replaced as a whole."""
    return stored.join(touched.select("hash").distinct(), "hash", "left_anti").unionByName(fresh.select(*stored.columns).distinct())


def image_tags(images: DataFrame) -> DataFrame:
    return images.select("hash", F.explode(tags_from_prompt("prompt")).alias("tag"), F.lit("prompt").alias("source"))


def upsert_sightings(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Latest sighting per (hash, group, row) overwrites; a blank group name does not."""
    fields = ["sent_at", "speaker", "speaker_uin", "group_name"]
    rows = stored.select("hash", "group_id", "row_id", *fields, F.lit(-1).cast("long").alias("seq")).unionByName(delta.select("hash", "group_id", "row_id", *fields, F.col("seq").cast("long")))
    named = F.coalesce(F.max_by("group_name", F.when(F.col("group_name") != "", F.col("seq"))), F.lit(""))
    return rows.groupBy("hash", "group_id", "row_id").agg(F.max_by(F.struct("sent_at", "speaker", "speaker_uin"), "seq").alias("l"), named.alias("group_name")).select("hash", "group_id", "row_id", "l.*", "group_name")


def invalid_answers(delta: DataFrame) -> DataFrame:
    """Requests whose answer kind and content disagree, with the reason."""
    reason = (F.when(~F.col("answer_kind").isin("", "text", "media"), "kind").when((F.col("answer_kind") == "text") & (F.col("answer_text") == ""), "text-missing")
              .when((F.col("answer_kind") == "media") & (F.size("answer_media") < 1), "media-missing"))
    return delta.withColumn("reason", reason).filter("reason is not null")


def upsert_requests(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge by (group, ask row). An answer is never erased by a blank one and a known image
    never by null; the other fields follow the newer record (``target_via`` and
    ``confidence`` too, even when the older image stays)."""
    latest = ["intent", "rule", "asker", "ask_text", "target_via", "confidence"]
    answer = ["answer_text", "answer_kind", "answer_media", "answer_by", "answer_sent_at"]
    rows = stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(delta.withColumn("seq", F.col("seq").cast("long")))
    keep = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    merged = rows.groupBy("group_id", "ask_row_id").agg(
        F.min_by("ask_sent_at", "seq").alias("ask_sent_at"), F.max_by(F.struct(*latest), "seq").alias("l"),
        F.coalesce(keep("group_name", F.col("group_name") != ""), F.lit("")).alias("group_name"), keep("image_hash", F.col("image_hash").isNotNull()).alias("image_hash"),
        F.coalesce(keep("image_owner", F.col("image_owner") != ""), F.lit("")).alias("image_owner"), F.max("image_sent_at").alias("image_sent_at"),
        F.coalesce(F.max_by(F.struct(*answer), F.when(F.col("answer_kind") != "", F.col("seq"))), F.max_by(F.struct(*answer), "seq")).alias("a"))
    return merged.select("group_id", "ask_row_id", "ask_sent_at", "group_name", "l.*", "image_hash", "image_owner", "image_sent_at", "a.*")


def changed_files(files: DataFrame, state: DataFrame, parser_version: int) -> DataFrame:
    """Files whose size or time changed, or that an older parser read."""
    current = state.filter(F.col("parser_version") >= parser_version).select("file_path", "file_size", "file_mtime")
    return files.join(current, ["file_path", "file_size", "file_mtime"], "left_anti")


def mark_missing(images: DataFrame, listing: DataFrame) -> DataFrame:
    """After a full sweep: files no longer listed are flagged and lose their path."""
    there = listing.select("file_path", F.lit(True).alias("_there")).distinct()
    gone = (F.col("file_path") != "") & (F.col("file_missing") == 0) & F.col("_there").isNull()
    joined = images.join(there, "file_path", "left").withColumn("_gone", gone)
    return joined.withColumn("file_missing", F.when(F.col("_gone"), 1).otherwise(F.col("file_missing")).cast("long")).withColumn(
        "swept_path", F.when(F.col("_gone"), F.col("file_path"))).withColumn("file_path", F.when(F.col("_gone"), "").otherwise(F.col("file_path"))).drop("_there", "_gone")


def drop_scan_state(state: DataFrame, swept: DataFrame) -> DataFrame:
    return state.join(swept.filter("swept_path is not null").select(F.col("swept_path").alias("file_path")), "file_path", "left_anti")


def placeholders(requests: DataFrame, images: DataFrame, originals: DataFrame) -> DataFrame:
    """Minimal image rows for request targets and answers the catalog does not know."""
    wanted = requests.select(F.col("image_hash").alias("hash")).unionByName(requests.select(F.explode(F.transform("answer_media", lambda m: m["hash"])).alias("hash"))).filter("hash is not null").distinct()
    new = wanted.join(images.select("hash"), "hash", "left_anti").join(originals, "hash", "left")
    return new.select("hash", F.coalesce("path", F.lit("")).alias("file_path"), F.lit(fv.PLACEHOLDER_GENERATOR).alias("generator"))


def media_backfill(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entry to restore each asset from that has neither file nor durable copy:
    the newest run wins. ``manifest``: hash, run_id, copied_path, position."""
    needed = images.filter("object_path = '' and (file_path = '' or file_missing = 1)").select("hash")
    usable = manifest.filter("copied_path <> ''").withColumn("hash", F.lower("hash"))
    return usable.join(needed, "hash", "left_semi").groupBy("hash").agg(
        F.max_by(F.struct("run_id", "copied_path"), F.struct("run_id", (-F.col("position")).alias("p"))).alias("e")).select("hash", "e.*")


def reconcile_media(entries: DataFrame, images: DataFrame, objects: DataFrame, files: DataFrame) -> DataFrame:
    """Durable-copy verdict per image hash of the manifests.

    ``entries``: hash, copied_path, remote_status, position. ``objects``: hash, object_path.
    ``files``: path, md5, generator for the readable copies (see ``read_file_digests``).
    """
    copy = entries.withColumn("hash", F.lower("hash")).join(files.withColumnRenamed("path", "copied_path"), "copied_path", "left")
    chosen = copy.groupBy("hash").agg(
        F.min_by(F.struct("copied_path", "remote_status", "md5", "generator"), F.struct(F.col("md5").isNull().alias("absent"), "position")).alias("e")).select("hash", "e.*")
    known = images.select("hash", F.col("generator").alias("known_generator"))
    rows = chosen.join(known, "hash", "left").join(objects, "hash", "left")
    fresh = F.col("known_generator").isNull() & F.col("object_path").isNull()
    has_copy = F.col("md5").isNotNull()
    parsed = F.coalesce(F.col("generator") != "unknown", F.lit(False))
    untracked = fresh & ((F.coalesce(F.col("remote_status"), F.lit("")) != "downloaded") | ~has_copy)
    status = (F.when(untracked, "untracked").when(fresh & (F.col("md5") != F.col("hash")), "hash-mismatch").when(fresh & ~parsed, "untracked")
              .when(F.col("object_path").isNotNull(), "reused").when(~has_copy, "source-missing").when(F.col("md5") != F.col("hash"), "hash-mismatch").otherwise("stored"))
    kept = status.isin("reused", "stored")
    change = F.when(kept & F.col("known_generator").isNull() & parsed, "discovered").when(kept & (F.col("known_generator") == fv.PLACEHOLDER_GENERATOR) & parsed, "upgraded").otherwise("none")
    path = F.when(kept, F.coalesce("object_path", F.concat(F.lit("objects/"), F.substring("hash", 1, 2), F.lit("/"), "hash")))
    return rows.select("hash", status.alias("status"), change.alias("change"), path.alias("object_path"))


def expired_runs(runs: DataFrame, now: int, days: int) -> DataFrame:
    """Runs whose id stamp is older than the cutoff. Reports only, deletes nothing."""
    return runs.withColumn("created_unix", F.coalesce(run_created("run_id"), F.col("modified_unix"))).filter(F.col("created_unix") < now - days * 86400)


def harvest_stats(refs: DataFrame, originals: DataFrame, outcomes: DataFrame, images: DataFrame, requests: DataFrame, new_placeholders: DataFrame) -> DataFrame:
    """Counters of one harvest as (counter, value) rows.
    ``refs``: hash. ``outcomes``: hash, outcome (parsed, stripped or skipped)."""
    joined = refs.select("hash").distinct().join(originals.select("hash", F.lit(1).alias("_o")), "hash", "left").join(outcomes, "hash", "left").join(images.select("hash", F.lit(1).alias("_i")), "hash", "left")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    here = F.col("_o").isNotNull()
    media = joined.agg(F.count(F.lit(1)).alias("image_refs"), n(~here, "original_missing"), *[n(here & (F.col("outcome") == o), o) for o in ("parsed", "stripped", "skipped")],
                       n(here & (F.col("_i").isNotNull() | (F.col("outcome") == "parsed")), "attributed"))
    asked = requests.agg(F.count(F.lit(1)).alias("requests"), n(F.col("answer_kind") != "", "answered_requests"))
    made = new_placeholders.agg(F.count(F.lit(1)).alias("placeholders"))
    rows = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in df.columns])).alias("r")).select("r.*")
    return rows(media).unionByName(rows(asked)).unionByName(rows(made))


