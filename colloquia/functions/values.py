"""Time, number and small classification expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import trim_space

ZONE = "Asia/Hong_Kong"
LOCAL_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_local(c: str | Column, zone: str = ZONE) -> Column:
    """Unix seconds as local wall time text (session zone UTC)."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(_c(c)), zone), LOCAL_FORMAT)


def local_day(c: str | Column, zone: str = ZONE) -> Column:
    return F.substring(to_local(c, zone), 1, 10)


def from_local(c: str | Column, zone: str = ZONE) -> Column:
    """Local wall time text back to Unix seconds; null when it is not a time."""
    text = F.regexp_replace(_c(c), "T", " ")
    valid = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), text)
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(valid, F.lit(LOCAL_FORMAT)), zone))


def evidence_range(evidence: Column, pad: int = 600, zone: str = ZONE) -> Column:
    """Padded span of the local times cited in an array of evidence lines."""
    def cited(line: Column) -> Column:
        stamp = F.regexp_extract(line, fv.LOCAL_STAMP, 1)
        full = F.when(F.length(stamp) == 16, F.concat(stamp, F.lit(":00"))).otherwise(stamp)
        return from_local(full, zone)

    times = F.filter(F.transform(evidence, cited), lambda t: t.isNotNull())
    return F.struct((F.array_min(times) - pad).alias("from_unix"), (F.array_max(times) + pad).alias("to_unix"))


def run_created(c: str | Column) -> Column:
    digits = F.regexp_extract(_c(c), r"(\d{8}-\d{6})$", 1)
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd-HHmmss")), "+08:00"))


def aspect(width: str | Column, height: str | Column) -> Column:
    w, h = _c(width), _c(height)
    ratio = F.when((w > 0) & (h > 0), w / h)
    return F.when(ratio.between(0.95, 1.05), "square").when(ratio > 1.05, "landscape").when(ratio < 0.95, "portrait")


def param_num(params: str | Column, key: str) -> Column:
    return F.get_json_object(_c(params), f"$.{key}").try_cast("double")


def importance_rank(c: str | Column) -> Column:
    rank = F.lit(3)
    for place, level in reversed(list(enumerate(fv.IMPORTANCE))):
        rank = F.when(_c(c) == level, place).otherwise(rank)
    return rank.cast("long")


def format_bytes(c: str | Column, digits: int = 2) -> Column:
    size = _c(c).cast("double")
    power = F.least(F.floor(F.log(size) / F.log(F.lit(1024.0))), F.lit(len(fv.BYTE_UNITS) - 1)).cast("int")
    unit = F.element_at(F.array(*[F.lit(u) for u in fv.BYTE_UNITS]), power + 1)
    scaled = size / F.pow(F.lit(1024.0), power)
    number = F.when(power == 0, F.format_string("%.0f", scaled)).otherwise(F.format_string(f"%.{digits}f", scaled))
    return F.when(size > 0, F.concat_ws(" ", number, unit)).otherwise("0 B")


def empty_state(ratio: Column, messages: Column, media: Column) -> Column:
    return (F.when(ratio <= 0, "unscanned").when(ratio < 0.999, "partial").when(messages == 0, "no-messages")
            .when(media > 0, "media-unavailable").otherwise("no-media"))


def bare_row_id(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), "^m", "")


def display_text(kinds: Column, text: Column, is_media: Column) -> Column:
    """Text of a message as listed: media rows get their kind's label before the caption."""
    kind = F.split(kinds, ",")[0]
    label = F.lit("媒体")
    for name, shown in fv.KIND_LABELS.items():
        label = F.when(kind == name, shown).otherwise(label)
    caption = trim_space(text)
    tagged = F.concat(F.lit("["), label, F.lit("]"), F.when(caption != "", F.concat(F.lit(" "), caption)).otherwise(""))
    return F.when(is_media == 1, tagged).otherwise(text)


def normalize_group_sets(sets: DataFrame, keep: int = 20) -> DataFrame:
    """Named id lists in input order: numeric distinct ids, 1 to 50 of them, first 20 sets."""
    ids = F.filter(F.array_distinct(F.transform("group_ids", lambda g: F.trim(g))), lambda g: g.rlike("^[0-9]+$"))
    clean = sets.select("set_order", F.substring(F.trim("name"), 1, 40).alias("name"), ids.alias("group_ids"))
    return clean.filter((F.col("name") != "") & F.size("group_ids").between(1, 50)).orderBy("set_order").limit(keep)


def normalize_watchlist(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("group_id").alias("group_id"), F.coalesce("name", F.lit("")).alias("name")).filter(F.col("group_id").rlike("^[0-9]+$"))


def scan_warning(truncated: Column, aborted: Column, covered_from: Column) -> Column:
    """Sentence about an incomplete scan, null when the scan was complete."""
    reason = F.when(aborted, "read errors stopped the scan early").otherwise("the scan row budget was used up")
    missing = F.when(covered_from.isNotNull(), F.concat(F.lit("messages before "), covered_from, F.lit(" may be missing"))).otherwise(
        "messages of the requested range may be missing")
    return F.when(truncated | aborted, F.concat_ws("; ", reason, missing))


def summary_basis(mode: Column, total: Column, included: Column, chunks: Column, capped: Column) -> Column:
    """Sentence telling which share of the messages a summary rests on."""
    used = F.coalesce(included, total)
    share = F.concat(used.cast("string"), F.lit("/"), total.cast("string"))
    parts = F.concat(F.lit(" in "), F.coalesce(chunks, F.lit(1)).cast("string"), F.lit(" parts"))
    return (F.when((mode == "single") & (used < total), F.concat(F.lit("summary rests on the latest "), share))
            .when(mode == "single", F.lit(None)).when(capped, F.concat(F.lit("summary covers "), share, parts))
            .otherwise(F.concat(F.lit("summary covers all "), total.cast("string"), parts)))
