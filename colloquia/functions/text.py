"""Text cleaning and extraction as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Plain column reuse repeats the expression, and pushing a filter down repeats it again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_c(c), F.lit(fv.SPACE_CHARS))


def speaker(*names: str | Column, fallback: str = "Unknown") -> Column:
    return F.coalesce(*[F.nullif(_c(n), F.lit("")) for n in names], F.lit(fallback))


def light_clean(c: str | Column) -> Column:
    return trim_space(F.regexp_replace(F.regexp_replace(_c(c), fv.LIGHT_CONTROL, ""), " {2,}", " "))


def report_clean(c: str | Column) -> Column:
    text = F.regexp_replace(_c(c), r"\x00", "")
    return trim_space(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def clean_extracted(c: str | Column) -> Column:
    return trim_space(F.regexp_replace(_c(c), fv.ANSWER_CONTROL, ""))


def _word_like(token: Column) -> Column:
    """Case changes are the borders between runs of capitals and other letters."""
    runs = F.regexp_count(token, F.lit("[A-Z]+|[^A-Z]+"))
    word = (F.length(token) <= 14) & token.rlike("(?i)[aeiou]") & (runs - 1 <= 2)
    return ~token.rlike("^[A-Za-z'-]+$") | word


def sanitize_snippet(c: str | Column) -> Column:
    segments = F.regexp_extract_all(F.regexp_replace(_c(c), fv.SNIPPET_NOISE, " "), F.lit(fv.SNIPPET_SEGMENT), F.lit(1))
    text = F.substring(F.trim(F.array_join(F.filter(segments, _word_like), " ")), 1, 120)
    return F.when(F.length(text) >= 4, text).otherwise("")


def extract_urls(c: str | Column) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(fv.URL), F.lit(1))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds any of the words; plain substring tests, no pattern matching."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def tokens(c: str | Column) -> Column:
    """Lower-cased useful tokens of a text, repeats kept.

    All Han characters lie above U+2E7F, so texts without such a character skip the search
    for them (testing the script of every character is slow)."""
    text = _c(c)
    han = F.when(text.rlike(r"[^\x00-\u2E7F]"), F.regexp_extract_all(text, F.lit(fv.HAN_TOKEN), F.lit(1))).otherwise(F.array().cast("array<string>"))
    raw = F.concat(han, F.regexp_extract_all(text, F.lit(fv.LATIN_TOKEN), F.lit(1)))
    return F.filter(F.transform(raw, lambda t: F.lower(t)), lambda t: F.length(t).between(2, 24) & ~t.isin(fv.STOP_WORDS))


def token_counts(c: str | Column) -> Column:
    """Distinct useful tokens of a text with their number of occurrences, ordered by token."""
    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i - 1) != F.get(t, i)))
        return bind(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(t, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).cast("long").alias("n"))))

    none = F.array().cast("array<struct<token:string,n:bigint>>")
    return bind(F.sort_array(tokens(c)), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(none))


def counts_of(messages: DataFrame, text: str = "text") -> Column:
    """``token_counts`` of the messages' texts; ready ones, where the messages bring that column."""
    return F.col("token_counts") if text == "text" and "token_counts" in messages.columns else token_counts(text)


def text_head(c: str | Column) -> Column:
    return F.substring(F.regexp_replace(_c(c), r"\s+", " "), 1, 18)


def body_snippet(c: str | Column, n: int = 220) -> Column:
    kept = F.regexp_replace(_c(c), fv.BODY_KEEP, " ")
    return F.substring(trim_space(F.regexp_replace(kept, f"{fv.JS_SPACE}+", " ")), 1, n)


def likely_tokens(c: str | Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(_c(c), F.lit(fv.LIKELY_TOKEN), F.lit(1))), 1, 12)


def tags_from_prompt(c: str | Column) -> Column:
    parts = F.split(F.regexp_replace(_c(c), "<[^>]*>", ","), "[,\n]")

    def clean(raw: Column) -> Column:
        text = F.regexp_replace(raw, r"\\(.)", "$1")
        text = F.regexp_replace(F.regexp_replace(text, r"[{}\[\]()]", ""), r":\s*[\d.]+\s*$", "")
        return F.lower(trim_space(F.regexp_replace(text, f"{fv.JS_SPACE}+", " ")))

    kept = F.filter(F.transform(parts, clean), lambda t: F.length(t).between(1, 80))
    return F.slice(F.array_distinct(kept), 1, 200)


def merge_key(c: str | Column) -> Column:
    return F.lower(trim_space(F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"{fv.JS_SPACE}+", " ")))


def normalize_path(c: str | Column) -> Column:
    return trim_space(F.regexp_replace(F.translate(_c(c), "/", "\\"), fv.PATH_KEEP, ""))


def safe_name(c: str | Column) -> Column:
    return F.substring(F.regexp_replace(_c(c), "[^A-Za-z0-9_.-]+", "_"), 1, 120)


def sanitize_stem(c: str | Column, fallback: str = "image") -> Column:
    text = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r'[\x00-\x1F<>:"/\\|?*]', "_")
    text = F.regexp_replace(F.regexp_replace(text, f"{fv.JS_SPACE}+", " "), "[. ]+$", "")
    text = F.substring(trim_space(text), 1, 80)
    return F.when((text == "") | F.lower(text).isin(fv.RESERVED_NAMES), fallback).otherwise(text)


def preview(c: str | Column, n: int = 400) -> Column:
    text = F.coalesce(_c(c), F.lit(""))
    return F.struct(F.substring(text, 1, n).alias("text"), (F.length(text) > n).alias("truncated"))


def message_line(local: Column, group: Column, who: Column, text: Column) -> Column:
    return F.concat(F.lit("["), local, F.lit("] ["), group, F.lit("] "), who, F.lit(": "), text)


def csv_cell(c: Column) -> Column:
    """Guard cells a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
