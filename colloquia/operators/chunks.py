"""Summaries: packing lines into chunks, caps, requests, validation and merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquia.functions.text import merge_key, message_line, trim_space
from colloquia.functions.values import importance_rank, to_local
from colloquia.operators.ordered import ordinal, top_per_key
from colloquia.session import durable

MAX_LINES, MAX_CHARS = 400, 50000
PART_CHARS = 1 << 25


def flat_text(c: str) -> Column:
    return trim_space(F.regexp_replace(c, r"\s+", " "))


def _line(text: Column) -> Column:
    label = F.coalesce(F.nullif("name", F.lit("")), F.nullif("group_id", F.lit("")), F.lit("unknown-group"))
    return message_line(to_local("sent_at"), label, F.col("speaker"), text)


def line_heads(messages: DataFrame, names: DataFrame, bodies: DataFrame) -> DataFrame:
    """Lines without their text: ``head``, ``body_id`` and the length of the whole line. ``messages`` bring a ``body_id``,
    ``bodies`` (body_id, body) the flat texts, each once however many messages show it; only their lengths move."""
    lengths = bodies.select("body_id", F.length("body").alias("_n"))
    shown = messages.join(lengths, "body_id", "left").join(names, "group_id", "left").withColumn("head", _line(F.lit("")))
    return shown.select("group_id", "row_id", "sent_at", "input_order", "head", "body_id", (F.length("head") + F.coalesce("_n", F.lit(0))).cast("long").alias("line_length"))


def summary_lines(messages: DataFrame, names: DataFrame) -> DataFrame:
    """One-line form of every message with its length."""
    line = _line(flat_text("text"))
    return messages.join(names, "group_id", "left").select("group_id", "row_id", "sent_at", "input_order", line.alias("line")).withColumn("line_length", F.length("line").cast("long"))


def next_starts(lengths: np.ndarray, max_lines: int, max_chars: int) -> np.ndarray:
    """For every line, where the next chunk begins if a chunk begins at this line."""
    upto = np.concatenate([[0], np.cumsum(lengths + 1)])
    here = np.arange(len(lengths))
    fits = np.searchsorted(upto, upto[here] + max_chars, side="right") - 1
    return np.minimum(np.maximum(fits, here + 1), here + max_lines)


def entries(tables: DataFrame) -> DataFrame:
    """(group_id, for, entry, before): where every bucket is entered and how many chunks begin before it.

    ``tables`` (cut): group_id, segment, entry, begun, leave. Tables of neighbours are composed
    to tables of twice the length until one covers a group, then entries go down again: rounds
    grow with the logarithm of the buckets, and every join has a row for each (segment, entry),
    so a group of any size is spread evenly.
    """
    by = ["group_id", "segment"]
    levels, last = [tables], tables.agg(F.max("segment")).first()[0] or 0
    while last > 0:
        now, last = levels[-1], last // 2
        right = now.filter("segment % 2 = 1").select("group_id", (F.col("segment") - 1).alias("segment"), F.col("entry").alias("leave"), F.col("begun").alias("_begun"), F.col("leave").alias("_leave"))
        both = now.filter("segment % 2 = 0").join(right, [*by, "leave"], "left")
        levels.append(durable(both.select("group_id", F.expr("segment div 2").alias("segment"), "entry", (F.col("begun") + F.coalesce("_begun", F.lit(0))).alias("begun"), F.coalesce("_leave", "leave").alias("leave"))))
    zero = F.lit(0).cast("long")
    at = tables.filter("segment = 0 and entry = 0").select(*by, "entry", zero.alias("before"))
    for level in reversed(levels[:-1]):
        left = at.withColumn("segment", F.col("segment") * 2)
        right = left.join(level, [*by, "entry"]).select("group_id", (F.col("segment") + 1).alias("segment"), F.col("leave").alias("entry"), (F.col("before") + F.col("begun")).alias("before"))
        at = durable(left.unionByName(right))
    return at.withColumnRenamed("segment", "for")


def pack_chunks(lines: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, max_chunks: int | None = None, bucket_lines: int | None = None) -> DataFrame:
    """(group_id, row_id, line_no, chunk): consecutive lines packed greedily; ``max_chunks`` drops later chunks.

    A chunk begins at most ``max_lines`` lines after the one before it, so a bucket of lines is
    entered at one of its first ``max_lines`` places. Each bucket answers all of them (chunks
    begun, place of entry into the next bucket); these small tables are composed by joins (see
    ``entries``), then each bucket numbers its own lines.
    """
    width = bucket_lines or 32 * max_lines
    slim = ordinal(lines.select("group_id", "row_id", "sent_at", "input_order", "line_length"), ["group_id"], ["sent_at", "input_order", "row_id"], "line_no")
    slim = durable(slim.select("group_id", "row_id", "line_no", "line_length").withColumn("bucket", F.floor((F.col("line_no") - 1) / width).cast("long")))
    ahead = (F.col("line_no") - 1) % width < max_lines  # the first lines also help the bucket before them
    shared = slim.withColumn("for", F.explode(F.when(ahead & (F.col("bucket") > 0), F.array("bucket", F.col("bucket") - 1)).otherwise(F.array("bucket"))))

    def steps(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        rows = rows.sort_values("line_no")
        own = int((rows["bucket"] == rows["for"]).sum())
        return rows, next_starts(rows["line_length"].to_numpy(), max_lines, max_chars), own

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        rows, following, own = steps(rows)
        begun, leave = np.zeros(own, "int64"), np.zeros(own, "int64")
        for i in range(own - 1, -1, -1):
            inside = following[i] < own
            begun[i] = 1 + (begun[following[i]] if inside else 0)
            leave[i] = leave[following[i]] if inside else following[i] - own
        entries = min(own, max_lines)
        return pd.DataFrame({"group_id": rows["group_id"].iloc[0], "bucket": rows["for"].iloc[0], "entry": np.arange(entries), "begun": begun[:entries], "leave": leave[:entries]})

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows, following, own = steps(rows)
        chunk, at = np.zeros(own, "int64"), int(rows["entry"].iloc[0])
        while at < own:
            chunk[at] = 1
            at = int(following[at])
        rows = rows.iloc[:own].assign(chunk=np.cumsum(chunk) + int(rows["before"].iloc[0]))
        return rows[["group_id", "row_id", "line_no", "chunk"]]

    tables = shared.groupBy("group_id", "for").applyInPandas(table, "group_id string, bucket long, entry long, begun long, leave long")
    entered = entries(durable(tables.select("group_id", F.col("bucket").alias("segment"), "entry", "begun", "leave")))
    packed = shared.join(entered, ["group_id", "for"]).groupBy("group_id", "for").applyInPandas(number, "group_id string, row_id string, line_no long, chunk long")
    return packed if max_chunks is None else packed.filter(F.col("chunk") <= max_chunks)


def chunk_coverage(lines: DataFrame, packed: DataFrame) -> DataFrame:
    """Included and total lines, chunk count, mode and cap flag per group."""
    total = lines.groupBy("group_id").agg(F.count(F.lit(1)).alias("total_messages"))
    used = packed.groupBy("group_id").agg(F.count(F.lit(1)).alias("included_messages"), F.max("chunk").alias("chunks"))
    joined = total.join(used, "group_id", "left")
    included = F.coalesce("included_messages", F.lit(0))
    return joined.select("group_id", "total_messages", included.cast("long").alias("included_messages"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"),
                         (included < F.col("total_messages")).alias("capped"), F.when(F.coalesce("chunks", F.lit(0)) <= 1, "single").otherwise("mapreduce").alias("mode"))


def cap_tail(lines: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """Of the last ``max_lines`` lines the newest that fit ``max_chars`` (always one)."""
    last = top_per_key(lines, ["group_id"], [F.col("sent_at").desc(), F.col("input_order").desc()], max_lines, "from_end")
    back = Window.partitionBy("group_id").orderBy("from_end")
    before = F.coalesce(F.sum(F.col("line_length") + 1).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flagged = last.withColumn("_before", before).withColumn(
        "_over", ((F.col("_before") + F.col("line_length") > max_chars) & (F.col("from_end") > 1)).cast("int"))
    return flagged.withColumn("_stop", F.max("_over").over(back.rowsBetween(Window.unboundedPreceding, 0))).filter("_stop = 0").drop("_before", "_over", "_stop")


def cap_head(lines: DataFrame, max_lines: int = 500, max_chars: int = MAX_CHARS) -> DataFrame:
    """Of the last ``max_lines`` lines the oldest whose running length stays within ``max_chars``."""
    last = top_per_key(lines, ["group_id"], [F.col("sent_at").desc(), F.col("input_order").desc()], max_lines, "from_end")
    forward = Window.partitionBy("group_id").orderBy(F.col("from_end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("_used", F.sum("line_length").over(forward)).filter(F.col("_used") <= max_chars).drop("_used")


def summary_requests(lines: DataFrame, packed: DataFrame, header: DataFrame, topics: DataFrame, blocks: DataFrame, bodies: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One JSON request per chunk: lines, part number, local topic and block hints.

    Hints: the 12 first topics with 6 keywords and the 24 first blocks of the group. A
    chunk is bounded by its line and character budget.

    ``lines`` and ``bodies``: see ``line_heads``. Chunks are dealt by time to parts of about ``part_chars``
    characters, and a text moves once to each part that shows it, not once a line.
    """
    hints = top_per_key(topics.filter("message_count > 0"), ["group_id"], [F.col("topic").asc()], 12).groupBy("group_id").agg(
        F.sort_array(F.collect_list(F.struct("topic", "name", F.col("message_count").alias("count"), F.slice(F.split("keywords", ","), 1, 6).alias("keywords")))).alias("topics"))
    spans = top_per_key(blocks, ["group_id"], [F.col("start_unix").asc()], 24).groupBy("group_id").agg(
        F.sort_array(F.collect_list(F.struct("start_unix", "end_unix", F.col("message_count").alias("messages")))).alias("blocks"))
    slim = lines.select("group_id", "row_id", "sent_at", "head", "body_id", "line_length").join(packed, ["group_id", "row_id"]).groupBy("group_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "head", "body_id"))).alias("lines"), F.min("sent_at").alias("_first"), F.sum("line_length").alias("_chars"))
    chunks = durable(slim)
    totals = chunks.groupBy("group_id").agg(F.max("chunk").alias("parts"))
    about = totals.join(header, "group_id", "left").join(hints, "group_id", "left").join(spans, "group_id", "left")
    context = F.struct("first_local", "last_local", "text_messages", "media_messages", "topics", "blocks")
    known = about.select("group_id", "parts", context.alias("context"))
    parts = 1 + (chunks.agg(F.sum("_chars")).first()[0] or 0) // part_chars
    dealt = durable(chunks.repartitionByRange(parts, "_first", "group_id", "chunk").withColumn("_part", F.spark_partition_id()))
    wanted = dealt.select(F.col("_part").alias("_of"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["body_id"]))).alias("body_id")).distinct()
    texts = wanted.join(bodies, "body_id").select("_of", "body_id", "body")
    head = F.to_json(F.struct(F.col("chunk").alias("part"), "parts", "context"))
    rows = dealt.join(known, "group_id").select("_part", "group_id", "chunk", "parts", head.alias("request"), "lines")
    filled = rows.groupBy("_part").cogroup(texts.groupBy("_of")).applyInArrow(_filled_chunks, "group_id string, chunk long, parts long, request string, messages array<string>")
    request = F.concat(F.expr("left(request, length(request) - 1)"), F.lit(',"messages":'), F.to_json("messages"), F.lit("}"))
    return filled.select("group_id", "chunk", "parts", F.size("messages").cast("long").alias("line_count"), request.alias("request"))


def _filled_chunks(rows: pa.Table, texts: pa.Table) -> pa.Table:
    """The chunks of a part with their whole lines."""
    body = dict(zip(texts["body_id"].to_pylist(), texts["body"].to_pylist(), strict=True))
    whole = [[None if x["head"] is None else x["head"] + (body.get(x["body_id"]) or "") for x in lines] for lines in rows["lines"].to_pylist()]
    return rows.select(["group_id", "chunk", "parts", "request"]).append_column("messages", pa.array(whole, pa.list_(pa.string())))


def summarize_with(requests: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """Run a user's summariser over the request rows; keep its JSON answers or the error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for request in batch["request"]:
                try:
                    answers.append(fn(request))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - one failed chunk must not fail the job
                    answers.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"group_id": batch["group_id"], "chunk": batch["chunk"], "answer": answers, "error": errors})

    return requests.select("group_id", "chunk", "request").mapInPandas(run, "group_id string, chunk long, answer string, error string")


_S = T.StringType()
SUMMARY_SCHEMA = T.StructType([
    T.StructField("summary", _S),
    T.StructField("topics", T.ArrayType(T.StructType([
        T.StructField("title", _S), T.StructField("summary", _S), T.StructField("importance", _S), T.StructField("messageCountEstimate", T.DoubleType()),
        T.StructField("details", T.ArrayType(_S)), T.StructField("evidence", T.ArrayType(_S))]))),
    T.StructField("timeline", T.ArrayType(T.StructType([
        T.StructField("start", _S), T.StructField("end", _S), T.StructField("title", _S), T.StructField("summary", _S), T.StructField("messageCountEstimate", T.DoubleType())]))),
    T.StructField("uncategorized", T.ArrayType(T.StructType([T.StructField("hkt", _S), T.StructField("speaker", _S), T.StructField("note", _S)]))),
    T.StructField("actions", T.ArrayType(T.StructType([
        T.StructField("owner", _S), T.StructField("task", _S), T.StructField("status", _S), T.StructField("resolution", _S), T.StructField("evidence", _S)]))),
    T.StructField("risks", T.ArrayType(T.StructType([T.StructField("severity", _S), T.StructField("risk", _S), T.StructField("evidence", _S)]))),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("title", _S), T.StructField("url", _S), T.StructField("why", _S)]))),
    T.StructField("announcementDraft", _S),
])


def _filled(c: Column) -> Column:
    return F.coalesce(trim_space(c) != "", F.lit(False))


def normalize_summary(answers: DataFrame) -> DataFrame:
    """Parsed answers with ``reason`` null when valid, else the first broken rule."""
    parsed = answers.withColumn("p", F.from_json("answer", SUMMARY_SCHEMA))
    level = lambda c: F.coalesce(c.isin("high", "medium", "low"), F.lit(False))
    every = lambda c, rule: F.forall(F.coalesce(c, F.array()), rule)
    p = lambda n: F.col(f"p.{n}")
    texts = lambda c: c.isNotNull() & F.forall(F.coalesce(c, F.array()), _filled)
    rules = [
        (F.json_object_keys("answer").isNotNull(), "not-json"), (_filled(p("summary")), "summary"), (p("topics").isNotNull(), "topics"),
        (every(p("topics"), lambda t: _filled(t["title"]) & _filled(t["summary"]) & level(t["importance"]) & t["messageCountEstimate"].isNotNull() & texts(t["details"]) & texts(t["evidence"])), "topic"),
        (every(p("timeline"), lambda t: _filled(t["start"]) & _filled(t["title"]) & _filled(t["summary"])), "timeline"),
        (every(p("uncategorized"), lambda u: _filled(u["hkt"]) & _filled(u["speaker"]) & _filled(u["note"])), "uncategorized"),
        (every(p("actions"), lambda a: _filled(a["task"]) & _filled(a["evidence"])), "action"),
        (every(p("risks"), lambda r: level(r["severity"]) & _filled(r["risk"]) & _filled(r["evidence"])), "risk"),
        (every(p("links"), lambda x: _filled(x["title"]) & _filled(x["url"]) & _filled(x["why"])), "link"),
    ]
    reason = F.lit(None).cast("string")
    for holds, name in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return parsed.withColumn("reason", reason)


def quick_summary(answers: DataFrame, cap: int = 12) -> DataFrame:
    """Short form: summary, at most 12 points and 12 actions with text."""
    schema = "summary string, points array<string>, actions array<struct<text string, status string, resolution string>>"
    parsed = answers.withColumn("q", F.from_json("answer", schema))
    actions = F.filter(F.transform(F.coalesce("q.actions", F.array()), lambda a: F.struct(
        F.coalesce(a["text"], F.lit("")).alias("text"), F.when(a["status"] == "resolved", "resolved").otherwise("open").alias("status"),
        F.coalesce(a["resolution"], F.lit("")).alias("resolution"))), lambda a: a["text"] != "")
    return parsed.select("group_id", F.coalesce("q.summary", F.lit("")).alias("summary"), F.slice(F.coalesce("q.points", F.array()), 1, cap).alias("points"), F.slice(actions, 1, cap).alias("actions"))


def trim_partial(parsed: DataFrame) -> DataFrame:
    """Cut every list of a partial summary to what the merge step reads."""
    cut = lambda c, n: F.slice(F.coalesce(F.col(f"p.{c}"), F.array()), 1, n)
    topics = F.transform(cut("topics", 8), lambda t: F.struct(
        t["title"].alias("title"), t["summary"].alias("summary"), t["importance"].alias("importance"), t["messageCountEstimate"].alias("messageCountEstimate"),
        F.slice(F.coalesce(t["details"], F.array()), 1, 2).alias("details"), F.slice(F.coalesce(t["evidence"], F.array()), 1, 1).alias("evidence")))
    return parsed.withColumn("p", F.struct(
        F.coalesce("p.summary", F.lit("")).alias("summary"), topics.alias("topics"), cut("timeline", 8).alias("timeline"), cut("uncategorized", 10).alias("uncategorized"),
        cut("actions", 10).alias("actions"), cut("risks", 6).alias("risks"), cut("links", 8).alias("links")))


def _items(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.select("group_id", F.col("chunk").alias("part"), F.posexplode(f"p.{name}").alias("pos", "i")).select("group_id", F.struct("part", "pos").alias("at"), "i.*")


def merge_topics(parsed: DataFrame, keep: int = 10) -> DataFrame:
    """Topics of all parts united by title: summed estimates, strongest importance."""
    rows = _items(parsed, "topics").filter(_filled(F.col("title"))).withColumn("key", merge_key("title"))
    level = F.when(F.col("importance").isin("high", "medium", "low"), F.col("importance")).otherwise("medium")
    texts = lambda c: F.filter(F.coalesce(c, F.array()), _filled)
    # each part's lists are bounded by its answer; the distinct texts per title are merged
    # from (part, position) order
    gathered = lambda c, n: F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", texts(F.col(c)).alias("x")))), lambda s: s["x"]))), 1, n)
    united = rows.groupBy("group_id", "key").agg(
        F.min("at").alias("first_at"), F.min_by(trim_space("title"), "at").alias("title"),
        F.min_by(F.when(_filled(F.col("summary")), trim_space("summary")).otherwise(trim_space("title")), "at").alias("summary"),
        F.min_by(level, importance_rank(level)).alias("importance"), F.sum(F.coalesce("messageCountEstimate", F.lit(0.0))).alias("message_count_estimate"),
        gathered("details", 5).alias("details"), gathered("evidence", 4).alias("evidence"))
    return top_per_key(united, ["group_id"], [F.col("message_count_estimate").desc(), F.col("first_at").asc()], keep).drop("first_at", "key")


def merge_actions(parsed: DataFrame, keep: int = 15) -> DataFrame:
    """Actions united by task: resolved in any part wins, open ones first (any other status comes after them)."""
    rows = _items(parsed, "actions").filter(_filled(F.col("task"))).withColumn("key", merge_key("task"))
    resolved = F.col("status") == "resolved"
    united = rows.groupBy("group_id", "key").agg(
        F.min("at").alias("first_at"), F.min_by(F.struct("owner", "task", "evidence", "status"), "at").alias("f"),
        F.coalesce(F.bool_or(resolved), F.lit(False)).alias("done"),
        F.coalesce(F.max_by("resolution", F.when(resolved & F.col("resolution").isNotNull(), F.col("at"))), F.min_by("resolution", "at")).alias("resolution"))
    valid = united.select("group_id", "first_at", (~F.col("done") & F.col("f.status").eqNullSafe("open")).alias("waits"), F.when(_filled(F.col("f.owner")), F.col("f.owner")).alias("owner"), F.col("f.task").alias("task"),
                          F.when(F.col("done"), "resolved").otherwise("open").alias("status"), F.when(_filled(F.col("resolution")), F.col("resolution")).alias("resolution"), F.col("f.evidence").alias("evidence"))
    first = top_per_key(valid, ["group_id"], [F.col("waits").desc(), F.col("first_at").asc()], keep)
    return first.filter(_filled(F.col("evidence"))).drop("first_at", "waits")


def merge_first(parsed: DataFrame, name: str, key: Column, valid: Column, keep: int) -> DataFrame:
    """First item per key over all parts, invalid ones dropped afterwards, then capped."""
    rows = _items(parsed, name).withColumn("key", key).filter("key is not null")
    columns = [c for c in rows.columns if c not in ("group_id", "key", "at")]
    first = rows.groupBy("group_id", "key").agg(F.min_by(F.struct("at", *columns), "at").alias("i")).select("group_id", "i.*")
    return top_per_key(first.filter(valid), ["group_id"], [F.col("at").asc()], keep).drop("at")


def merge_partials(parsed: DataFrame) -> dict[str, DataFrame]:
    """Deterministic merge of the partial summaries of each group, one table per list."""
    level = F.col("severity").isin("high", "medium", "low")
    note = F.when(_filled(F.col("note")), F.concat_ws("|", F.coalesce("hkt", F.lit("")), merge_key("note")))
    lines = _items(parsed, "timeline").filter(_filled(F.col("start")) & _filled(F.col("title")) & _filled(F.col("summary")))
    says = parsed.filter(_filled(F.col("p.summary"))).select("group_id", "chunk", trim_space(F.col("p.summary")).alias("summary"))
    return {
        "summary": top_per_key(says, ["group_id"], [F.col("chunk").asc()], 4).groupBy("group_id").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "summary"))), lambda s: s["summary"]), " ").alias("summary")),
        "topics": merge_topics(parsed), "actions": merge_actions(parsed),
        "timeline": top_per_key(lines, ["group_id"], [F.col("at").asc()], 12).drop("at"),
        "uncategorized": merge_first(parsed, "uncategorized", note, _filled(F.col("hkt")) & _filled(F.col("speaker")), 15),
        "risks": merge_first(parsed, "risks", F.when(_filled(F.col("risk")), merge_key("risk")), level & _filled(F.col("evidence")), 10),
        "links": merge_first(parsed, "links", F.when(_filled(F.col("url")), merge_key("url")), _filled(F.col("title")) & _filled(F.col("why")), 12),
    }
