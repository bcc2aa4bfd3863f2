"""Asset catalog: structured search, facets, reasons, cards, coverage."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import preview
from colloquia.functions.values import aspect, bare_row_id, param_num
from colloquia.operators.intervals import inside_coverage
from colloquia.operators.ordered import split_window, time_bucket, top_per_key
from colloquia.session import durable

PAGE_DEFAULT, PAGE_MAX, CARD_CHILDREN, LISTED_GROUPS = 60, 200, 8, 40


# letters with diacritics and their plain forms, derived from their Unicode decomposition
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_MARKED, _PLAIN = "".join(m for m, _ in _PAIRS), "".join(p for _, p in _PAIRS)


def _any(column: Column, values: Sequence[str]) -> Column:
    """Case-insensitive substring of any value; wildcards in values are plain characters."""
    hit = F.lit(False)
    for value in values:
        hit = hit | F.contains(F.lower(column), F.lit(value.lower()))
    return hit


def f_like(images: DataFrame, column: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    kept = images.filter(_any(F.col(column), include)) if include else images
    return kept.filter(~_any(F.col(column), exclude)) if exclude else kept


def f_generator(images: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    kept = images.filter(F.col("generator").isin([v.lower() for v in include])) if include else images
    return kept.filter(~F.col("generator").isin([v.lower() for v in exclude])) if exclude else kept


def f_exists(images: DataFrame, child: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return images.join(child.filter(_any(F.col(column), values)).select("hash").distinct(), "hash", "left_semi")


def f_not_exists(images: DataFrame, child: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return images.join(child.filter(_any(F.col(column), values)).select("hash").distinct(), "hash", "left_anti")


def f_group(images: DataFrame, sightings: DataFrame, values: Sequence[str]) -> DataFrame:
    hit = F.col("group_id").isin(list(values)) | _any(F.col("group_name"), values)
    return images.join(sightings.filter(hit).select("hash").distinct(), "hash", "left_semi")


def f_seed(images: DataFrame, seed: str) -> DataFrame:
    return images.filter(F.get_json_object("params_json", "$.seed") == seed)


def f_range(images: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Inclusive bounds on steps, cfg, width and height."""
    source = {"steps": param_num("params_json", "steps"), "cfg": param_num("params_json", "cfgScale"), "width": F.col("width"), "height": F.col("height")}
    for field, (low, high) in bounds.items():
        if low is not None:
            images = images.filter(source[field] >= low)
        if high is not None:
            images = images.filter(source[field] <= high)
    return images


def f_aspect(images: DataFrame, wanted: str) -> DataFrame:
    return images.filter(aspect("width", "height") == wanted)


def f_date(images: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """UTC days on the file time, the last day included."""
    if first is not None:
        images = images.filter(F.col("file_mtime") >= F.unix_timestamp(F.lit(f"{first} 00:00:00")))
    if last is not None:
        images = images.filter(F.col("file_mtime") <= F.unix_timestamp(F.lit(f"{last} 23:59:59")))
    return images


def has_file() -> Column:
    return ((F.col("file_missing") == 0) & (F.col("file_path") != "")) | (F.col("object_path") != "")


def f_flags(images: DataFrame, flags: Mapping[str, bool], loras: DataFrame, sightings: DataFrame, requests: DataFrame) -> DataFrame:
    plain = {"prompt": F.col("prompt") != "", "negative": F.col("negative_prompt") != "", "file": has_file()}
    answered = requests.filter("answer_kind <> '' and image_hash is not null").select(F.col("image_hash").alias("hash"))
    child = {"lora": loras.select("hash"), "sender": sightings.select("hash"), "answer": answered}
    for flag, wanted in flags.items():
        if flag in plain:
            images = images.filter(plain[flag] if wanted else ~plain[flag])
        elif flag in child:
            images = images.join(child[flag].distinct(), "hash", "left_semi" if wanted else "left_anti")
    return images


def text_tokens(images: DataFrame, loras: DataFrame) -> DataFrame:
    """(hash, token), repeats included: prompt, negative, checkpoint and style names, cut at
    non-alphanumerics, case and diacritics folded. No shuffle."""
    fold = lambda c: F.lower(F.translate(c, _MARKED, _PLAIN))
    words = images.select("hash", F.concat_ws(" ", "prompt", "negative_prompt", "checkpoint").alias("t")).unionByName(loras.select("hash", F.col("lora_name").alias("t")))
    return words.select("hash", F.explode(F.split(fold("t"), r"[^\p{L}\p{N}]+")).alias("token")).filter("token <> ''")


def search_tokens(images: DataFrame, loras: DataFrame) -> DataFrame:
    """Inverted index of the catalog: its distinct (hash, token) pairs."""
    return text_tokens(images, loras).distinct()


def search_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+", query) if t]


def search_parts(query: str) -> list[str]:
    """The folded terms of a search, each once."""
    return sorted({p.lower().translate(str.maketrans(_MARKED, _PLAIN)) for t in search_terms(query) for p in t.split("_") if p})


def f_text(images: DataFrame, tokens: DataFrame, query: str) -> DataFrame:
    """Every term must start some token of the asset. One pass over the tokens: those that match
    no term go before anything is shuffled, and matched terms are gathered per asset instead
    of one join per term. All terms of a query count, however long it is."""
    parts = search_parts(query)
    if not parts:
        return images
    matched = F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.startswith(F.col("token"), p))
    found = tokens.select("hash", F.explode(matched).alias("term")).groupBy("hash").agg(F.collect_set("term").alias("terms")).filter(F.size("terms") == len(parts))
    return images.join(found.select("hash"), "hash", "left_semi")


def f_selection(images: DataFrame, hashes: Sequence[str] | DataFrame) -> DataFrame:
    """Hand-picked hashes on top of the filters: a short list, or a table with a ``hash`` column.

    Malformed ones are ignored; without any well-formed one nothing was selected, and all rows stay.
    """
    form = "^[a-f0-9]{32}$"
    if isinstance(hashes, DataFrame):
        picked = hashes.select("hash").filter(F.col("hash").rlike(form))
        return images if picked.isEmpty() else images.join(picked.distinct(), "hash", "left_semi")
    good = [h for h in hashes if re.fullmatch(form[1:-1], str(h))]
    return images.filter(F.col("hash").isin(good)) if good else images


def catalog_filter(images: DataFrame, spec: Mapping[str, Any], tags: DataFrame, loras: DataFrame, sightings: DataFrame, requests: DataFrame) -> DataFrame:
    """Fold a structured spec into predicates and semi joins: AND over fields, OR inside one.

    Plain predicates come first, so they reach the scan below the joins.
    """
    dropdown = lambda field, one: [*spec.get(field, []), *([spec[one]] if spec.get(one) else [])]
    out = f_like(images, "checkpoint", spec.get("checkpoints", []), spec.get("exclude_checkpoints", []))
    out = f_like(out, "prompt", spec.get("prompts", []), spec.get("exclude_prompts", []))
    out = f_generator(out, dropdown("generators", "generator"), spec.get("exclude_generators", []))
    if spec.get("seed"):
        out = f_seed(out, spec["seed"])
    out = f_range(out, spec.get("ranges", {}))
    if spec.get("aspect"):
        out = f_aspect(out, spec["aspect"])
    out = f_date(out, spec.get("date_from"), spec.get("date_to"))
    out = f_flags(out, spec.get("flags", {}), loras, sightings, requests)
    for child, column, field, one in [(tags, "tag", "tags", None), (loras, "lora_name", "loras", None), (sightings, "speaker", "senders", "sender")]:
        wanted = dropdown(field, one) if one else spec.get(field, [])
        out = f_exists(out, child, column, wanted) if wanted else out
        banned = spec.get(f"exclude_{field}", [])
        out = f_not_exists(out, child, column, banned) if banned else out
    wanted_groups = dropdown("groups", "group_id")
    out = f_group(out, sightings, wanted_groups) if wanted_groups else out
    if spec.get("text"):
        out = f_text(out, text_tokens(out, loras), spec["text"])
    return f_selection(out, spec.get("hashes", []))


def sort_columns(mode: str) -> list[Column]:
    """Order of a catalog listing; unknown modes fall back to the newest first."""
    modes = {
        "recent": [F.col("recency").desc(), F.col("parsed_at").desc(), F.col("hash").desc()], "oldest": [F.col("recency").asc(), F.col("parsed_at").asc(), F.col("hash").asc()],
        "asked": [F.col("ask_count").desc(), F.col("file_mtime").desc(), F.col("hash").desc()], "loras": [F.col("lora_count").desc(), F.col("file_mtime").desc(), F.col("hash").desc()],
        "largest": [F.col("file_size").desc(), F.col("hash").desc()], "promptLength": [F.length("prompt").desc(), F.col("hash").desc()]}
    return modes.get(mode, modes["recent"])


def with_sort_keys(images: DataFrame, mode: str, loras: DataFrame, sightings: DataFrame, requests: DataFrame) -> DataFrame:
    """Attach only the aggregate the order needs, reduced to one row per asset first."""
    if mode == "asked":
        n = requests.filter("image_hash is not null").groupBy(F.col("image_hash").alias("hash")).agg(F.count(F.lit(1)).alias("ask_count"))
        return images.join(n, "hash", "left").withColumn("ask_count", F.coalesce("ask_count", F.lit(0)))
    if mode == "loras":
        n = loras.groupBy("hash").agg(F.count(F.lit(1)).alias("lora_count"))
        return images.join(n, "hash", "left").withColumn("lora_count", F.coalesce("lora_count", F.lit(0)))
    if mode in ("largest", "promptLength"):
        return images
    seen = sightings.groupBy("hash").agg(F.max("sent_at").alias("_seen"))
    return images.join(seen, "hash", "left").withColumn("recency", F.coalesce("_seen", "file_mtime")).drop("_seen")


def catalog_sort(images: DataFrame, mode: str, loras: DataFrame, sightings: DataFrame, requests: DataFrame) -> DataFrame:
    return with_sort_keys(images, mode, loras, sightings, requests).orderBy(*sort_columns(mode))


def clamp_page(limit: int | None) -> int:
    return min(limit, PAGE_MAX) if isinstance(limit, int) and limit > 0 else PAGE_DEFAULT


def catalog_page(images: DataFrame, mode: str, loras: DataFrame, sightings: DataFrame, requests: DataFrame, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page of the ordered listing, and the total as a one-row frame."""
    ordered = catalog_sort(images, mode, loras, sightings, requests)
    return ordered.offset(offset).limit(clamp_page(limit)), images.agg(F.count(F.lit(1)).alias("total"))


def export_rows(images: DataFrame, mode: str, loras: DataFrame, sightings: DataFrame, requests: DataFrame, limit: int = 0) -> DataFrame:
    """Ordered selection for an export with the path to read each file from; all of it without a limit."""
    path = F.when((F.col("file_missing") != 1) & (F.col("file_path") != ""), F.col("file_path")).otherwise(F.col("object_path"))
    ordered = catalog_sort(images, mode, loras, sightings, requests)
    return (ordered.limit(limit) if limit > 0 else ordered).withColumn("export_path", path)


def attribution_reason(images: DataFrame, sightings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Why an asset has no sighting; the first matching reason in a fixed order."""
    seen = sightings.select("hash").distinct().withColumn("_seen", F.lit(True))
    judged = inside_coverage(images.join(seen, "hash", "left"), ranges, "file_mtime")
    reason = (F.when(F.col("_seen"), "attributed").when((F.col("object_path") == "") & (F.col("file_missing") == 1), "evicted")
              .when((F.col("object_path") == "") & (F.col("file_path") == ""), "unavailable").when(F.col("inside"), "not-in-messages").otherwise("outside-coverage"))
    return judged.withColumn("reason", reason).drop("_seen", "inside")


def reason_counts(images: DataFrame, sightings: DataFrame, ranges: DataFrame) -> DataFrame:
    judged = attribution_reason(images.filter(F.col("generator") != fv.PLACEHOLDER_GENERATOR), sightings, ranges)
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("images"))


def covered_span(ranges: DataFrame) -> DataFrame:
    return ranges.agg(F.min("start_unix").alias("from_unix"), F.max("end_unix").alias("to_unix"), F.count(F.lit(1)).alias("range_count"))


def catalog_summary(images: DataFrame, sightings: DataFrame, loras: DataFrame, tags: DataFrame, requests: DataFrame) -> DataFrame:
    """The library counters as (counter, value) rows; each table is read once."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    placeholder = F.col("generator") == fv.PLACEHOLDER_GENERATOR
    parts = [
        images.agg(n(~placeholder, "images"), n(placeholder, "placeholders"), n(F.col("prompt") != "", "with_prompt"),
                   n((F.col("file_missing") == 1) & (F.col("object_path") == ""), "file_missing"), n(F.col("object_path") != "", "durable_media")),
        sightings.agg(F.count_distinct("hash").alias("attributed"), F.count(F.lit(1)).alias("sightings")),
        loras.agg(F.count_distinct("lora_name").alias("loras")), tags.agg(F.count_distinct("tag").alias("tags")),
        requests.agg(F.count(F.lit(1)).alias("requests"), n(F.col("answer_kind") != "", "answered_requests"))]
    out = None
    for part in parts:
        rows = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in part.columns])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def facets(images: DataFrame, sightings: DataFrame, loras: DataFrame, tags: DataFrame) -> DataFrame:
    """Filter choices: (facet, value, images, rank) with the usual list lengths; generators are listed in full."""
    def top(df: DataFrame, name: str, value: str, count: Column, n: int | None) -> DataFrame:
        counted = df.groupBy(F.col(value).alias("value")).agg(count.alias("images")).withColumn("facet", F.lit(name))
        return top_per_key(counted, ["facet"], [F.col("images").desc(), F.col("value").asc()], n)

    rows, distinct = F.count(F.lit(1)), F.count_distinct("hash")
    real = images.filter(F.col("generator") != fv.PLACEHOLDER_GENERATOR)
    out = top(real, "generator", "generator", rows, None)
    for part in [top(sightings, "group", "group_id", distinct, 30), top(sightings.filter("speaker <> ''"), "sender", "speaker", distinct, 40),
                 top(images.filter("checkpoint <> ''"), "checkpoint", "checkpoint", rows, 20), top(loras, "lora", "lora_name", rows, 20), top(tags, "tag", "tag", rows, 40)]:
        out = out.unionByName(part)
    return out


def month_coverage(images: DataFrame, sightings: DataFrame, ranges: DataFrame, months: int | None = None) -> DataFrame:
    """Assets per UTC month: attributed, with prompt, and whether any scan touched the month.

    ``months`` keeps the latest months only. Whether a scan touched a month is one ordered pass
    over day marks: the furthest scan end before a month's last asset reaches its first one.
    """
    seen = sightings.select("hash").distinct().withColumn("_seen", F.lit(1))
    real = images.filter((F.col("generator") != fv.PLACEHOLDER_GENERATOR) & (F.col("file_mtime") > 0)).join(seen, "hash", "left")
    month = F.date_format(F.timestamp_seconds("file_mtime"), "yyyy-MM")
    table = real.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("images"), F.count("_seen").alias("attributed"), F.count(F.when(F.col("prompt") != "", 1)).alias("with_prompt"),
        F.min("file_mtime").alias("from_unix"), F.max("file_mtime").alias("to_unix"))
    if months is not None:
        table = table.orderBy(F.col("month").desc()).limit(months)
    # a range that starts by the month's end touches it when the furthest such end reaches its start
    starts = ranges.groupBy("start_unix").agg(F.max("end_unix").alias("end_unix"))
    flow = starts.unionByName(table.select(F.col("to_unix").alias("start_unix"), F.lit(None).cast("long").alias("end_unix"))).groupBy("start_unix").agg(
        F.max("end_unix").alias("end_unix")).withColumn("_day", time_bucket("start_unix"))
    reach = split_window(durable(flow), [], "_day", ["start_unix"], reach=("max_through", F.col("end_unix"))).select(F.col("start_unix").alias("to_unix"), "reach")
    touched = table.join(reach, "to_unix").filter(F.col("reach") >= F.col("from_unix")).select("month")
    return table.join(touched.withColumn("_t", F.lit(True)), "month", "left").select(
        "month", "images", "attributed", "with_prompt", "from_unix", "to_unix", F.coalesce("_t", F.lit(False)).alias("summarised"), (F.col("images") - F.col("attributed")).alias("unattributed"))


def recoverable(months: DataFrame) -> DataFrame:
    """Unattributed assets of months no scan ever touched."""
    return months.filter(~F.col("summarised")).agg(F.coalesce(F.sum("unattributed"), F.lit(0)).alias("recoverable"), F.count(F.lit(1)).alias("months"))


def group_contribution(sightings: DataFrame, keep: int | None = None) -> DataFrame:
    counted = sightings.groupBy("group_id").agg(F.max("group_name").alias("group_name"), F.count_distinct("hash").alias("images"), F.min("sent_at").alias("first_seen"), F.max("sent_at").alias("last_seen"))
    return counted if keep is None else counted.orderBy(F.col("images").desc(), "group_id").limit(keep)


def unattributed_groups(messages: DataFrame, names: DataFrame, sightings: DataFrame, strict: bool = True) -> DataFrame:
    """Groups with media messages but nothing in the catalog. ``strict=False`` compares the
    two 40-row lists, as the listing page does."""
    busy = messages.groupBy("group_id").agg(F.sum("is_media").alias("media_messages")).filter("media_messages > 0")
    known = group_contribution(sightings, None if strict else LISTED_GROUPS)
    busy = busy if strict else busy.orderBy(F.col("media_messages").desc(), "group_id").limit(LISTED_GROUPS)
    return busy.join(known, "group_id", "left_anti").join(names, "group_id", "left").select("group_id", F.coalesce("name", "group_id").alias("group_name"), "media_messages")


def new_since(images: DataFrame, since: int) -> DataFrame:
    real = F.col("generator") != fv.PLACEHOLDER_GENERATOR
    return images.agg(F.coalesce(F.max("file_mtime"), F.lit(0)).alias("watermark"), F.count(F.when(real & (F.col("file_mtime") > since), 1)).alias("new_images"), F.count(F.when(real, 1)).alias("images"))


def request_list(requests: DataFrame, images: DataFrame, only_answered: bool = False, limit: int | None = None) -> DataFrame:
    """Requests, newest first, with the state of the image they mean."""
    known = images.select(F.col("hash").alias("image_hash"), F.lit(1).alias("_k"), has_file().alias("_f"), ((F.col("file_missing") == 1) & (F.col("object_path") == "")).alias("_m"))
    rows = requests.filter("answer_kind <> ''") if only_answered else requests
    first = rows.orderBy(F.col("ask_sent_at").desc(), "group_id", "ask_row_id").limit(clamp_page(limit))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return first.join(known, "image_hash", "left").withColumn("image_known", F.col("_k").isNotNull()).withColumn("image_has_file", flag("_f")).withColumn("image_file_missing", flag("_m")).drop("_k", "_f", "_m")


def with_media_availability(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Flag each answer-media hash of a request: one row per (request, position)."""
    rows = requests.select("group_id", "ask_row_id", F.posexplode("answer_media").alias("position", "media"))
    known = images.select("hash", has_file().alias("has_file"))
    return rows.select("group_id", "ask_row_id", "position", F.col("media.hash").alias("hash")).join(known, "hash", "left").withColumn("has_file", F.coalesce("has_file", F.lit(False)))


def asset_cards(images: DataFrame, loras: DataFrame, sightings: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per asset with its styles, first eight sightings and first eight requests.

    Children are cut to eight per asset before they are gathered, so a widely shared picture
    cannot build a huge row.
    """
    def gathered(df: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
        first = top_per_key(df, ["hash"], [F.col(c).asc() for c in order], CARD_CHILDREN, "_r")
        return first.groupBy("hash").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))

    styles = loras.groupBy("hash").agg(F.sort_array(F.collect_set("lora_name")).alias("loras"))  # an asset's own styles
    seen = gathered(sightings, ["sent_at", "group_id", "row_id"], ["group_id", "group_name", "speaker", "sent_at"], "sightings")
    asked = gathered(requests.filter("image_hash is not null").withColumnRenamed("image_hash", "hash"), ["ask_sent_at", "group_id", "ask_row_id"], ["asker", "intent", "answer_kind", "answer_text", "ask_sent_at"], "requests")
    cards = images.join(styles, "hash", "left").join(seen, "hash", "left").join(asked, "hash", "left")
    shown = preview("prompt")
    return cards.withColumn("preview", shown).withColumn("has_file", has_file()).withColumn("is_placeholder", F.col("generator") == fv.PLACEHOLDER_GENERATOR)


def attribute(manifest: DataFrame, images: DataFrame, messages: DataFrame, names: DataFrame) -> DataFrame:
    """Sightings from manifest entries of known images, with time and names filled in.
    ``manifest``: hash, group_id, group_name, row_id, speaker."""
    known = manifest.join(images.select("hash"), "hash", "left_semi")
    posts = messages.filter("is_media = 1").select("group_id", bare_row_id("row_id").alias("row_id"), F.col("sent_at").alias("_at"), F.col("speaker").alias("_who"), F.col("speaker_uin").alias("_uin"))
    joined = known.join(posts, ["group_id", "row_id"], "left").join(names.withColumnRenamed("name", "_name"), "group_id", "left")
    fill = lambda c, o: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(o), F.lit("")).alias(c)
    return joined.select("hash", "group_id", "row_id", F.coalesce("_at", F.lit(0)).cast("long").alias("sent_at"), fill("speaker", "_who"), F.coalesce("_uin", F.lit("")).alias("speaker_uin"),
                         fill("group_name", "_name"), F.col("_at").isNull().alias("no_time"))


def attribution_stats(manifest: DataFrame, images: DataFrame, attributed: DataFrame) -> DataFrame:
    unknown = manifest.join(images.select("hash"), "hash", "left_anti").agg(F.count(F.lit(1)).alias("value")).withColumn("counter", F.lit("unknown_hash"))
    kept = attributed.agg(F.count(F.lit(1)).alias("matched"), F.count(F.when(F.col("no_time"), 1)).alias("no_time"))
    rows = kept.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in ["matched", "no_time"]])).alias("r")).select("r.counter", "r.value")
    return rows.unionByName(unknown.select("counter", "value"))


def effective_prompt(images: DataFrame, requests: DataFrame) -> DataFrame:
    """Own prompt, else the first non-blank chat answer, with its source."""
    answers = requests.filter((F.trim("answer_text") != "") & F.col("image_hash").isNotNull()).groupBy(F.col("image_hash").alias("hash")).agg(
        F.min_by(F.trim("answer_text"), F.struct("ask_sent_at", "group_id", "ask_row_id")).alias("_answer"))
    own = F.nullif(F.trim("prompt"), F.lit(""))
    return images.join(answers, "hash", "left").withColumn("effective_prompt", F.coalesce(own, "_answer", F.lit(""))).withColumn(
        "prompt_source", F.when(own.isNotNull(), "metadata").when(F.col("_answer").isNotNull(), "chat").otherwise("none")).drop("_answer")
