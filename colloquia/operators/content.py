"""Keyword statistics, time blocks, signals and report headers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.rules import read_rules, signals_of
from colloquia.functions.text import counts_of, extract_urls, message_line, token_counts
from colloquia.functions.values import local_day, to_local
from colloquia.operators.ordered import ordinal, time_bucket, top_per_key
from colloquia.session import durable, few

BLOCK_GAP_SECONDS = 1800
FEW_KEYS = 1 << 18  # that are broadcast with their numbers


def count_by(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Counts by key, largest first, ties by key."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), key)
    return counted if n is None else counted.limit(n)


def exploded_tokens(messages: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """One row per message and distinct token, with its occurrences ``n``: distinct messages are
    counted without shuffling (message, token) pairs."""
    return messages.select(*by, F.inline(counts_of(messages, text)))


def token_stats(messages: DataFrame, by: Sequence[str] = ("group_id",)) -> DataFrame:
    """Occurrences and distinct messages per token; rare tokens are left out."""
    return frequent(exploded_tokens(messages, by), by)


def frequent(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return useful(pairs.groupBy(*by, "token").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("messages")))


def useful(counted: DataFrame) -> DataFrame:
    return counted.filter((F.col("messages") >= 2) | (F.col("count") >= 3))


def token_order() -> list[Column]:
    return [F.col("messages").desc(), F.col("count").desc(), F.col("token").asc()]


def top_tokens(messages: DataFrame, n: int = 80, by: Sequence[str] = ("group_id",)) -> DataFrame:
    return top_per_key(token_stats(messages, by), list(by), token_order(), n, "token_rank")


def shared_token_stats(messages: DataFrame, texts: DataFrame, by: Sequence[str] = ("group_id",), most: int = 256) -> DataFrame:
    """``token_stats`` of messages that show texts of a table. ``messages``: text_id and ``by``; ``texts``: text_id, text.

    A token of a text moves once, with the numbers of the keys whose messages show the text (in lists of at
    most ``most``), and not once for every key; all are counted where they arrive. How much is shuffled
    depends on the texts, hardly on the number of keys, and no task holds the tokens of many texts for every key.
    """
    by = list(by)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by])
    keys = ordinal(messages.select(*by).distinct(), [], by, "_number").select(F.col("_number").cast("int"), *[F.col(c).alias(f"_k_{c}") for c in by])
    keys = few(durable(keys), FEW_KEYS)
    shows = messages.groupBy("text_id", *by).agg(F.count(F.lit(1)).alias("_shows")).join(keys, same)
    listed = shows.groupBy("text_id").agg(F.collect_list(F.struct("_number", "_shows")).alias("_all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / most).cast("int")), lambda i: F.slice("_all", i * most + 1, most))
    listed = listed.select("text_id", F.explode(cut).alias("_keys"))
    # numbers and counts as two plain lists: fewer bytes move with every token
    shown = texts.join(listed.select("text_id", F.col("_keys._number").alias("_numbers"), F.col("_keys._shows").alias("_shows")), "text_id")
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = shown.select("_numbers", "_shows", F.inline(token_counts("text"))).repartition(parts, "token")
    pairs = moved.select("token", "n", "_shows", F.posexplode("_numbers").alias("_at", "_number")).withColumn("_m", F.get("_shows", F.col("_at")))
    counted = pairs.groupBy("_number", "token").agg(F.sum(F.col("n") * F.col("_m")).alias("count"), F.sum("_m").alias("messages"))
    return useful(counted).join(keys, "_number").select(*[F.col(f"_k_{c}").alias(c) for c in by], "token", "count", "messages")


def shared_top_tokens(messages: DataFrame, texts: DataFrame, n: int = 80, by: Sequence[str] = ("group_id",)) -> DataFrame:
    """``top_tokens`` of messages that show texts of a table."""
    return top_per_key(shared_token_stats(messages, texts, by), list(by), token_order(), n, "token_rank")


def leading_tokens(messages: DataFrame, n: int, by: Sequence[str], cells: int = 1 << 12, first: int = 1 << 8, most_cells: int = 1 << 18) -> DataFrame:
    """``top_tokens`` where few keys have large vocabularies: most rare tokens are not shuffled to be counted.

    The tokens of a key fall into cells by their hash, and none is in more messages than its cell. The tokens
    of a key's ``first`` fullest cells are counted; the key is settled where its ``n``-th one is in more messages
    than the next cell. All tokens of other keys are counted, and where the cells are too many to be broadcast.
    The registered queries count every token (``shared_top_tokens``), which also moves less.
    """
    by = list(by)
    pairs = exploded_tokens(messages, by).withColumn("_cell", F.pmod(F.xxhash64("token"), F.lit(cells)))
    full = pairs.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_most"))
    fullest = durable(top_per_key(full, by, [F.col("_most").desc(), F.col("_cell").asc()], first + 1, "_place"))
    if fullest.count() > most_cells:
        return top_tokens(messages, n, by)
    keys = [*by, "_cell"]
    same = lambda names: reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names])
    named = lambda df, names: F.broadcast(df.select(*[F.col(c).alias(f"_k_{c}") for c in names]))
    kept = pairs.join(named(fullest.filter(F.col("_place") <= first), keys), same(keys), "left_semi")
    best = durable(top_per_key(frequent(kept, by), by, token_order(), n, "token_rank"))
    last = best.filter(F.col("token_rank") == n).select(*[F.col(c).alias(f"_k_{c}") for c in by], "messages")
    unsettled = durable(fullest.filter(F.col("_place") > first).join(last, same(by), "left").filter("messages is null or messages <= _most").select(*by))
    if unsettled.isEmpty():
        return best
    others = top_tokens(messages.join(named(unsettled, by), same(by), "left_semi"), n, by)
    return best.join(named(unsettled, by), same(by), "left_anti").unionByName(others)


def block_starts(seconds: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Start of the run each distinct (keys, sent_at) belongs to: a run breaks when the
    pause to the previous second is longer than ``gap``.

    Days of a key are scanned apart. Only the first second of a day depends on the days
    before it; the day summaries (first, last, last break) settle that.
    """
    keys = list(keys)
    days = [*keys, "_day"]
    base = durable(seconds.withColumn("_day", time_bucket("sent_at")))
    local = Window.partitionBy(*days).orderBy("sent_at")
    broke = F.when(F.col("sent_at") - F.lag("sent_at").over(local) > gap, F.col("sent_at"))
    marked = base.withColumn("_broke", broke).withColumn("_local", F.max("_broke").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*keys).orderBy("_day")
    summary = marked.groupBy(*days).agg(F.min("sent_at").alias("_first"), F.max("sent_at").alias("_last"), F.max("_broke").alias("_broke"))
    paused = summary.withColumn("_prev", F.lag("_last").over(across)).withColumn("_opens", F.col("_prev").isNull() | (F.col("_first") - F.col("_prev") > gap))
    latest = paused.withColumn("_latest", F.coalesce("_broke", F.when(F.col("_opens"), F.col("_first"))))
    carried = F.max("_latest").over(across.rowsBetween(Window.unboundedPreceding, -1))
    entry = latest.select(*days, F.when(F.col("_opens"), F.col("_first")).otherwise(carried).alias("_entry"))
    return marked.join(entry, days).select(*keys, "sent_at", F.coalesce("_local", "_entry").alias("block_start"))


def time_blocks(messages: DataFrame, by: Sequence[str] = ("group_id",), gap: int = BLOCK_GAP_SECONDS, top: int = 5) -> DataFrame:
    """Runs of conversation per key (``by=[]``: over everything), with their top speakers.

    Only distinct seconds are ordered; messages enter as counts per (second, speaker).
    """
    by = list(by)
    counts = messages.groupBy(*by, "sent_at", "speaker").agg(F.count(F.lit(1)).alias("n"))
    starts = block_starts(counts.select(*by, "sent_at").distinct(), by, gap)
    per_speaker = counts.join(starts, [*by, "sent_at"]).groupBy(*by, "block_start", "speaker").agg(
        F.sum("n").alias("n"), F.max("sent_at").alias("last"))
    blocks = per_speaker.groupBy(*by, "block_start").agg(F.max("last").alias("end_unix"), F.sum("n").alias("message_count"))
    best = top_per_key(per_speaker, [*by, "block_start"], [F.col("n").desc(), F.col("speaker").asc()], top).groupBy(*by, "block_start").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "speaker", "n"))),
                                 lambda s: F.concat(s["speaker"], F.lit(":"), s["n"].cast("string"))), ",").alias("top_speakers"))
    return blocks.join(best, [*by, "block_start"]).withColumnRenamed("block_start", "start_unix")


def last_n(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = ("sent_at", "input_order")) -> DataFrame:
    """The latest ``n`` rows per key; ``from_end`` is 1 for the newest."""
    return top_per_key(df, list(keys), [F.col(c).desc() for c in order], n, "from_end")


def signals(messages: DataFrame, keep: int = 80, rules: DataFrame | None = None) -> DataFrame:
    """Latest messages per group and signal (action and risk where no ``rules`` are given); a message can
    have several. ``rules``: see ``functions.rules``; an empty set finds nothing."""
    keys = ["group_id", "row_id", "sent_at", "input_order"]
    found = signals_of(messages, keys, read_rules(rules, "signal")).select(*keys, F.explode("signals").alias("signal"))
    return last_n(found, ["group_id", "signal"], keep)


def urls(messages: DataFrame) -> DataFrame:
    return messages.select("group_id", "row_id", "sent_at", F.posexplode(extract_urls("text")).alias("position", "url"))


def filter_group(messages: DataFrame, group: str) -> DataFrame:
    return messages.filter(F.col("group_id") == group)


def lines(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Transcript lines with their local day."""
    label = F.coalesce(F.nullif("name", F.lit("")), F.nullif("group_id", F.lit("")), F.lit("unknown-group"))
    named = messages.join(names, "group_id", "left")
    return named.select("group_id", "row_id", "sent_at", local_day("sent_at").alias("day"),
                        message_line(to_local("sent_at"), label, F.col("speaker"), F.col("text")).alias("line"))


def analysis_header(messages: DataFrame, media: DataFrame, names: DataFrame) -> DataFrame:
    """Scalar head of the analysis report per group."""
    texts = messages.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("text_messages"), F.min("sent_at").alias("first_unix"), F.max("sent_at").alias("last_unix"))
    shared = media.groupBy("group_id").agg(F.count_distinct("row_id").alias("media_messages"), F.count(F.lit(1)).alias("media_refs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return texts.join(shared, "group_id", "full").join(names, "group_id", "left").select(
        "group_id", F.coalesce("name", F.lit("")).alias("name"), zero("text_messages"), zero("media_messages"), zero("media_refs"),
        to_local("first_unix").alias("first_local"), to_local("last_unix").alias("last_local"))


def type_distribution(raw: DataFrame) -> DataFrame:
    return raw.groupBy("msg_type1", "msg_type2").agg(F.count(F.lit(1)).alias("count"))


def type_samples(raw: DataFrame, n: int = 120) -> DataFrame:
    """Newest rows of a group for inspection."""
    return top_per_key(raw, ["group_id"], [F.col("sent_at").desc(), F.col("input_order").desc()], n, "sample")
