"""Incremental export: ledger, file names, index records, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import csv_cell, sanitize_stem, trim_space
from colloquia.operators.catalog import effective_prompt
from colloquia.operators.ordered import ordinal


def plan_export(items: DataFrame, ledger: DataFrame, mode: str = "new") -> DataFrame:
    """Items an export writes: in ``new`` mode those the ledger does not hold."""
    return items.join(ledger.select("hash"), "hash", "left_anti") if mode == "new" else items


def preview_export(items: DataFrame, ledger: DataFrame, mode: str = "new") -> DataFrame:
    seen = ledger.select("hash", F.lit(1).alias("_s"))
    already = F.count("_s") if mode == "new" else F.lit(0).cast("long")
    return items.join(seen, "hash", "left").agg((F.count(F.lit(1)) - already).alias("fresh"), already.alias("already"))


def forget(ledger: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    return ledger.limit(0) if hashes is None else ledger.join(hashes.select("hash"), "hash", "left_anti")


def stem(mtime: Column, who: Column, checkpoint: Column, digest: Column) -> Column:
    day = F.when(mtime > 0, F.date_format(F.timestamp_seconds(mtime), "yyyyMMdd")).otherwise("00000000")
    model = F.regexp_replace(F.element_at(F.split(checkpoint, r"[\\/]"), -1), r"(?i)\.(safetensors|ckpt|pt|pth|bin)$", "")
    label = sanitize_stem(F.coalesce(F.nullif(who, F.lit("")), model))
    return F.concat_ws("_", day, label, F.substring(digest, 1, 8))


def build_stem(items: DataFrame) -> DataFrame:
    """Day, sender or model, and hash prefix. ``items`` carry the first sender as ``sender``."""
    return items.withColumn("stem", stem(F.col("file_mtime"), F.coalesce("sender", F.lit("")), F.col("checkpoint"), F.col("hash")))


def dedupe_stems(items: DataFrame, order: list[str]) -> DataFrame:
    """Suffix repeated stems (case ignored) with _2, _3, ... in export order."""
    numbered = ordinal(items.withColumn("_fold", F.lower("stem")), ["_fold"], order, "_n")
    return numbered.withColumn("stem", F.when(F.col("_n") > 1, F.concat_ws("_", "stem", F.col("_n").cast("string"))).otherwise(F.col("stem"))).drop("_fold", "_n")


def first_sighting_of(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("hash").agg(F.min_by(F.struct("speaker", "group_name", "group_id", "sent_at"), F.struct("sent_at", "group_id", "row_id")).alias("s")).select(
        "hash", F.col("s.speaker").alias("sender"), F.col("s.group_name").alias("groupName"), F.col("s.group_id").alias("groupId"), F.col("s.sent_at").alias("sentAt"))


def index_records(items: DataFrame, loras: DataFrame, sightings: DataFrame, requests: DataFrame) -> DataFrame:
    """The 17 fields of an export index row."""
    styles = loras.groupBy("hash").agg(F.sort_array(F.collect_set("lora_name")).alias("loras"))
    rows = effective_prompt(items, requests).join(styles, "hash", "left").join(first_sighting_of(sightings), "hash", "left")
    named = dedupe_stems(build_stem(rows), ["hash"])
    suffix = F.coalesce(F.nullif(F.regexp_extract("file_path", r"(\.[^./\\]+)$", 1), F.lit("")), F.lit(".png"))
    there = (F.col("file_path") != "") & (F.col("file_missing") == 0)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return named.select(
        "hash", F.when(there, F.concat("stem", suffix)).otherwise("").alias("imageFile"), F.when(F.col("effective_prompt") != "", F.concat("stem", F.lit(".txt"))).otherwise("").alias("promptFile"),
        "generator", F.col("effective_prompt").alias("prompt"), F.col("prompt_source").alias("promptSource"), F.col("negative_prompt").alias("negativePrompt"), "checkpoint",
        F.coalesce("loras", F.array().cast("array<string>")).alias("loras"), F.col("params_json").alias("params"), "width", "height", F.col("file_mtime").alias("fileMtime"),
        text("sender"), text("groupName"), text("groupId"), F.coalesce("sentAt", F.lit(0)).cast("long").alias("sentAt"))


def csv_records(records: DataFrame) -> DataFrame:
    """Index columns as guarded text cells; lists joined by `` | ``."""
    cell = lambda c: F.array_join("loras", " | ") if c == "loras" else F.col(c).cast("string")
    return records.select(*[csv_cell(cell(c)).alias(c) for c in fv.CSV_COLUMNS])


def sidecars(records: DataFrame) -> DataFrame:
    """(path, content) of the prompt files."""
    negative = F.when(trim_space("negativePrompt") != "", F.concat(F.lit("\n\nNegative prompt: "), trim_space("negativePrompt"))).otherwise("")
    return records.filter("promptFile <> ''").select(F.col("promptFile").alias("path"), F.concat("prompt", negative, F.lit("\n")).alias("content"))


def ledger_after(ledger: DataFrame, records: DataFrame, exported_at: int, folder: str) -> DataFrame:
    """Ledger with this export's rows written over older ones."""
    fresh = records.select("hash", F.lit(exported_at).cast("long").alias("exportedAt"), F.lit(folder).alias("outputDir"), "imageFile", "promptFile", "promptSource")
    return ledger.join(fresh, "hash", "left_anti").unionByName(fresh)


def stride_sample(candidates: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Every n-th candidate of the whole ordered list, so all parts of it are represented."""
    total = candidates.agg(F.count(F.lit(1)).alias("_total"))
    numbered = ordinal(candidates, [], order, "_n").withColumn("_k", F.lit(1))
    stride = F.greatest(F.floor(F.col("_total") / limit), F.lit(1))
    sized = numbered.join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return sized.filter((F.col("_n") - 1) % stride == 0).filter(F.floor((F.col("_n") - 1) / stride) < limit if limit > 0 else F.lit(True)).drop("_n", "_total")
