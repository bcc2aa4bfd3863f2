"""Run listing: scan and summary coverage, manifest counters, totals, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia.functions.values import run_created
from colloquia.operators.activity import COMPLETE_RATIO, coverage_status
from colloquia.operators.ordered import top_per_key


def run_scan_coverage(exports: DataFrame) -> DataFrame:
    """Covered share of each run's scan windows, weighted by groups.
    ``exports``: run_id, start_unix, end_unix, group_count, covered_from, has_covered."""
    valid = exports.filter("start_unix is not null and end_unix is not null and start_unix < end_unix and group_count > 0")
    start = F.when(F.col("has_covered"), F.col("covered_from")).otherwise(F.col("start_unix"))
    from_ = F.when(start.isNull(), F.col("end_unix")).otherwise(F.greatest("start_unix", F.least("end_unix", start)))
    summed = valid.groupBy("run_id").agg(
        F.sum((F.col("end_unix") - F.col("start_unix")) * F.col("group_count")).alias("total"), F.sum((F.col("end_unix") - from_) * F.col("group_count")).alias("covered_seconds"),
        F.min("start_unix").alias("requested_start"), F.max("end_unix").alias("requested_end"))
    ratio = F.col("covered_seconds") / F.col("total")
    known = summed.select("run_id", coverage_status(ratio).alias("scan_status"), F.round(ratio, 6).alias("scan_ratio"), "covered_seconds", (F.col("total") - F.col("covered_seconds")).alias("missing_seconds"), "requested_start", "requested_end")
    return exports.select("run_id").distinct().join(known, "run_id", "left").withColumn("scan_status", F.coalesce("scan_status", F.lit("unknown")))


def run_ai_coverage(analyses: DataFrame) -> DataFrame:
    """Share of messages that entered summaries. ``analyses``: run_id, total, included, used."""
    used = F.count(F.when(F.col("used"), 1))
    unknown = F.count(F.when(F.col("used") & F.col("included").isNull(), 1))
    summed = analyses.groupBy("run_id").agg(used.alias("u"), unknown.alias("x"), F.sum("total").alias("total"), F.sum(F.coalesce("included", F.lit(0))).alias("included"))
    ratio = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("included") / F.col("total"))
    status = (F.when(F.col("u") == 0, "not-used").when(F.col("x") > 0, "unknown").when(F.col("total") == 0, "empty").when(ratio >= COMPLETE_RATIO, "complete").otherwise("partial"))
    known = status.isin("empty", "complete", "partial")
    return summed.select("run_id", status.alias("ai_status"), F.when(known, F.round(ratio, 6)).alias("ai_ratio"),
                         F.when(status == "not-used", 0).when(known, F.col("included")).cast("long").alias("included_messages"), F.when(status == "not-used", 0).otherwise(F.col("total")).cast("long").alias("total_messages"))


def manifest_counters(manifest: DataFrame) -> DataFrame:
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    copied = F.coalesce(F.col("copied_path") != "", F.lit(False))
    return manifest.groupBy("run_id").agg(F.count(F.lit(1)).alias("refs"), n(copied, "copied"), n(F.col("copied_path").isNull() & F.col("url").isNull(), "missing"),
                                          n(F.col("copied_path").isNull() & (F.col("url") != ""), "url_only"))


def run_label(by_group: DataFrame) -> DataFrame:
    """``name (count)`` of the three largest groups of each run."""
    top = top_per_key(by_group, ["run_id"], [F.col("count").desc(), F.col("name").asc()], 3)
    return top.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name", "count"))), lambda s: F.concat(s["name"], F.lit(" ("), s["count"].cast("string"), F.lit(")"))), ", ").alias("groups"))


def run_summary(topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stored summary, else the names of the three largest topics, else a constant."""
    top = top_per_key(topics.filter("count > 0"), ["run_id"], [F.col("count").desc(), F.col("name").asc()], 3).groupBy("run_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), " / ").alias("_topics"))
    return summaries.join(top, "run_id", "left").select("run_id", F.coalesce(F.nullif("summary", F.lit("")), "_topics", F.lit("No summary")).alias("summary"))


def run_rows(runs: DataFrame, scan: DataFrame, ai: DataFrame, media: DataFrame, labels: DataFrame, summary: DataFrame) -> DataFrame:
    """Listing row of every run, newest first by the stamp in its id."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = runs.join(scan, "run_id", "left").join(ai, "run_id", "left").join(media, "run_id", "left").join(labels, "run_id", "left").join(summary, "run_id", "left")
    return joined.select("run_id", F.coalesce(run_created("run_id"), F.col("modified_unix")).alias("created_unix"), "text_messages", "media_messages", F.coalesce("groups", F.lit("Unknown")).alias("groups"),
                         F.coalesce("summary", F.lit("No summary")).alias("summary"), F.coalesce("scan_status", F.lit("unknown")).alias("scan_status"), "scan_ratio", F.coalesce("ai_status", F.lit("not-used")).alias("ai_status"),
                         zero("refs"), zero("copied"), zero("missing"), zero("url_only"), "group_ids").orderBy(F.col("created_unix").desc(), "run_id")


def runs_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("runs"), F.sum("text_messages").alias("text_messages"), F.sum("media_messages").alias("media_messages"), F.sum("copied").alias("copied"), F.sum("missing").alias("missing"))


def runs_filter(rows: DataFrame, text: str = "", group: str | None = None, coverage: str | None = None) -> DataFrame:
    term = text.strip().lower()
    kept = rows
    if term:
        hit = F.lit(False)
        for column in ("groups", "summary", "run_id"):
            hit = hit | F.contains(F.lower(column), F.lit(term))
        kept = kept.filter(hit)
    kept = kept if group is None else kept.filter(F.array_contains("group_ids", group))
    return kept if coverage is None else kept.filter(F.col("scan_status") == coverage)


def storage_by_category(files: DataFrame) -> DataFrame:
    """Bytes and files per run folder category (``.../<run>/<category>/...``)."""
    category = F.coalesce(F.nullif(F.regexp_extract("path", r"/runs/[^/]+/([^/]+)/", 1), F.lit("")), F.lit("other"))
    return files.groupBy(category.alias("category")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))
