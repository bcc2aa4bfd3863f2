"""One harvest: pair requests, sight images, parse originals and fold all into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia.functions.params import detect_metadata
from colloquia.operators.graph import parse_graph
from colloquia.operators.media import first_sighting, original_index
from colloquia.operators.pairing import pair_requests
from colloquia.operators.upserts import changed_files, harvest_stats, image_tags, placeholders, replace_children, upsert_images, upsert_requests, upsert_sightings


def parse_originals(chunks: DataFrame) -> DataFrame:
    """Metadata of files by their text chunks. ``chunks``: hash, file_path, file_size,
    file_mtime, chunks map."""
    joined = chunks.join(parse_graph(chunks), "hash", "left").withColumn("meta", detect_metadata(F.col("chunks"), F.col("graph")))
    return joined.select("hash", "file_path", "file_size", "file_mtime", F.coalesce("meta.generator", F.lit("unknown")).alias("generator"), F.coalesce("meta.prompt", F.lit("")).alias("prompt"),
                         F.coalesce("meta.negative_prompt", F.lit("")).alias("negative_prompt"), F.coalesce("meta.checkpoint", F.lit("")).alias("checkpoint"), "meta.loras", F.to_json("meta.params").alias("params_json"))


def harvest(messages: DataFrame, refs: DataFrame, quotes: DataFrame, files: DataFrame, chunks: DataFrame, store: dict[str, DataFrame], now: int, parser_version: int = 2) -> dict[str, DataFrame]:
    """New versions of the catalog tables after one run.

    ``store`` holds images (columns that a parse does not give stay), sightings, requests, scan_state and loras. Returns those plus tags
    and the counters. Running it twice changes nothing, and the second run parses no file
    again: every file read now is in the returned scan_state.
    """
    pairs = pair_requests(messages, refs, quotes).withColumn("seq", F.lit(1).cast("long")).withColumn("group_name", F.lit(""))
    seen = first_sighting(refs)
    originals = original_index(files)
    wanted = chunks.join(seen.select("hash"), "hash", "left_semi")
    fresh = changed_files(wanted, store["scan_state"], parser_version)
    parsed = parse_originals(fresh)
    good = parsed.filter("generator <> 'unknown'").withColumn("parsed_at", F.lit(now).cast("long"))
    fields = ["file_path", "file_size", "file_mtime", "generator", "prompt", "negative_prompt", "checkpoint", "params_json", "parsed_at"]
    images = upsert_images(store["images"], good.select("hash", *fields))
    added = placeholders(pairs, images, originals)
    blank = added.select("hash", "file_path", F.lit(0).cast("long").alias("file_size"), F.lit(0).cast("long").alias("file_mtime"), "generator", F.lit("").alias("prompt"), F.lit("").alias("negative_prompt"),
                         F.lit("").alias("checkpoint"), F.lit("{}").alias("params_json"), F.lit(now).cast("long").alias("parsed_at"), F.lit(0).cast("long").alias("file_missing"), F.lit("").alias("object_path"))
    all_images = images.unionByName(blank, allowMissingColumns=True).select(*images.columns)
    sighted = seen.join(all_images.select("hash"), "hash", "left_semi").select("hash", "group_id", "row_id", "sent_at", "speaker", F.col("sender").alias("speaker_uin"), F.lit("").alias("group_name"), F.lit(1).cast("long").alias("seq"))
    stored = store["requests"].columns
    outcome = parsed.select("hash", F.when(F.col("generator") == "unknown", "stripped").otherwise("parsed").alias("outcome")).unionByName(
        wanted.join(fresh.select("hash"), "hash", "left_anti").select("hash", F.lit("skipped").alias("outcome")))
    loras = good.select("hash", F.explode("loras").alias("l")).select("hash", F.col("l.name").alias("lora_name"), F.col("l.weight").alias("weight"))
    state = fresh.select("file_path", "file_size", "file_mtime", F.lit(parser_version).cast("long").alias("parser_version")).distinct()
    kept_state = store["scan_state"].join(state.select("file_path"), "file_path", "left_anti").select(*state.columns)
    return {"images": all_images, "sightings": upsert_sightings(store["sightings"], sighted), "requests": upsert_requests(store["requests"], pairs.select(*stored, "seq")),
            "tags": image_tags(all_images), "loras": replace_children(store["loras"], good, loras) if "loras" in store else loras.distinct(),
            "scan_state": kept_state.unionByName(state),
            "stats": harvest_stats(seen, originals, outcome, images, pairs, added)}
