"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from colloquia import fixed_values as fv
from colloquia.functions.asks import looks_like_prompt
from colloquia.functions.text import clean_extracted
from colloquia.operators.upserts import append_coverage, ingest_messages, upsert_names
from colloquia.sources.exports import explode_exports, parse_exports
from colloquia.sources.lake import EventLake, KeyedTable

LATE_SECONDS = 600  # scans overlap by ten minutes, so rows can come that late
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_time(rows: DataFrame, seconds: str = "sent_at", name: str = "ts", late: int = LATE_SECONDS) -> DataFrame:
    return rows.withColumn(name, F.timestamp_seconds(seconds)).withWatermark(name, f"{late} seconds")


def stream_exports(spark: SparkSession, folder: str) -> DataFrame:
    """New export documents of a folder as (file, value) rows."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("file"), "value")


def first_of_each(messages: DataFrame, late: int = LATE_SECONDS) -> DataFrame:
    """Drop repeats of a message that arrive within the late bound; state stays bounded."""
    return with_time(messages, late=late).dropDuplicatesWithinWatermark(["group_id", "row_id"])


def ingest_stream(documents: DataFrame, lake: str, checkpoint: str) -> StreamingQuery:
    """Fold export documents into the Parquet lake.

    Messages go to an ``EventLake``: a batch opens the (group bucket, day) folders its rows fall
    into, and others only where a membership sketch has all bits of one of its keys, so what
    it reads depends on the batch and not on the lake. Names are a keyed table of which only
    the mentioned buckets are rewritten. Coverage is one folder per batch. A batch that is run
    again after a failure gives the same rows.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        tables = explode_exports(parse_exports(batch))
        columns = ["group_id", "row_id", "sent_at", "speaker", "text", "is_media", "media_kinds", "speaker_uin"]
        delta = tables["text"].select(*columns, "file", "input_order").unionByName(tables["media"].select(*columns, "file", "input_order"))
        delta = delta.withColumn("input_order", F.struct("file", "input_order")).drop("file")
        message_lake(lake).append(delta, lambda stored, new: ingest_messages(stored, new).select(*columns), batch_id)
        append_coverage(tables["scans"]).write.mode("overwrite").parquet(f"{lake}/scan_ranges/batch={batch_id}")
        names = tables["names"]
        name_table(lake).upsert(names.withColumn("seq", F.col("seq").cast("long")), upsert_names, names.select("group_id", "name"))

    return documents.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def message_lake(lake: str) -> EventLake:
    return EventLake(f"{lake}/messages")


def name_table(lake: str) -> KeyedTable:
    return KeyedTable(f"{lake}/group_names", ("group_id",), 64)


def slot_activity_stream(messages: DataFrame, slot: int, offset: int = 0, late: int = LATE_SECONDS) -> DataFrame:
    """Counts per (group, slot) as messages arrive. Exact speaker counts come from the
    second stage, ``speakers_of``, over the per-speaker counts of this one."""
    width, start = f"{slot} seconds", f"{offset % slot} seconds"
    return with_time(messages, late=late).groupBy("group_id", F.window("ts", width, width, start).alias("w"), "speaker").agg(
        F.count(F.lit(1)).alias("message_count"), F.sum("is_media").alias("media_count"), F.min("sent_at").alias("first_unix"), F.max("sent_at").alias("last_unix"))


def speakers_of(per_speaker: DataFrame, start: int, slot: int) -> DataFrame:
    """Slot totals from the (finalised) per-speaker rows of ``slot_activity_stream``."""
    index = F.floor((F.unix_timestamp("w.start") - start) / slot).cast("long")
    return per_speaker.groupBy("group_id", index.alias("slot_index")).agg(
        F.sum("message_count").alias("message_count"), F.sum("media_count").alias("media_count"), F.count(F.lit(1)).alias("speaker_count"), F.min("first_unix").alias("first_unix"), F.max("last_unix").alias("last_unix"))


def session_blocks(messages: DataFrame, gap: int, late: int = LATE_SECONDS) -> DataFrame:
    """Conversation or media runs per group; a run closes once the watermark passes its gap.

    Sessions end strictly at the gap, so one second is added to join messages exactly
    ``gap`` apart, as the batch operator does.
    """
    return with_time(messages, late=late).groupBy("group_id", F.session_window("ts", f"{gap + 1} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("message_count"), F.min("sent_at").alias("start_unix"), F.max("sent_at").alias("end_unix")).select("group_id", "start_unix", "end_unix", "message_count")


def latest_marks(rows: DataFrame) -> DataFrame:
    """Newest read mark per group (update mode)."""
    return rows.groupBy("group_id").agg(F.max(F.struct("sent_at", "row_id")).alias("m")).select("group_id", "m.sent_at", "m.row_id")


def latest_coverage(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("group_id").agg(F.max("end_unix").alias("coverage_end"))


def answer_pairs(asks: DataFrame, messages: DataFrame, window: int = fv.ANSWER_WINDOW, late: int = LATE_SECONDS) -> DataFrame:
    """Ask and answer candidates as an interval join of two streams. ``earliest_answers``
    keeps the first per ask in the sink."""
    left = with_time(asks.select("group_id", F.col("row_id").alias("ask_row_id"), F.col("sent_at").alias("ask_at"), F.col("sender").alias("asker")), "ask_at", "ask_ts", late)
    texts = messages.withColumn("text", clean_extracted("text")).filter(looks_like_prompt("text"))
    right = with_time(texts.select(F.col("group_id").alias("g"), F.col("sent_at").alias("answer_at"), F.col("sender").alias("answer_sender"), F.col("input_order").alias("answer_order"), "text"), "answer_at", "answer_ts", late)
    near = F.expr(f"group_id = g AND answer_ts >= ask_ts AND answer_ts <= ask_ts + interval {window} seconds AND (asker = '' OR asker <> answer_sender)")
    return left.join(right, near).drop("g", "ask_ts", "answer_ts")


class FirstAnswers(StatefulProcessor):
    """First answer of every ask of one (group, window-wide bucket), told once the watermark has passed all that could answer.

    State: the asks of the bucket, and per second of it and the next one the first candidate
    and the first of another sender. That is all any ask can need, so a busy second costs its
    rows and never their product. A timer ends the bucket and clears its state.
    """

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asks = handle.getMapState("asks", "row_id string", "sent_at long, sender string")
        self.seconds = handle.getMapState("seconds", "sent_at long", "ord_1 long, sender_1 string, text_1 string, ord_2 long, sender_2 string, text_2 string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for ask in frame[frame["is_ask"]].itertuples():
                self.asks.updateValue((ask.row_id,), (int(ask.sent_at), ask.sender))
            said = frame[~frame["is_ask"]].sort_values(["sent_at", "ord"], kind="stable").drop_duplicates(["sent_at", "sender"])
            for second, group in said.groupby("sent_at").head(2).groupby("sent_at"):
                found = [(int(c.ord), c.sender, c.text) for c in group.itertuples()]
                if self.seconds.containsKey((int(second),)):
                    known = self.seconds.getValue((int(second),))
                    found += [tuple(known[:3])] + ([tuple(known[3:])] if known[3] is not None else [])
                found.sort(key=lambda c: c[0])
                other = next((c for c in found if c[1] != found[0][1]), (None, None, None))
                self.seconds.updateValue((int(second),), (*found[0], *other))
        self.handle.registerTimer((int(key[1]) + 2) * self.window * 1000)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        candidates = sorted((int(k[0]), tuple(v)) for k, v in self.seconds.iterator())
        # from each second on: the nearest candidate and the nearest of another sender
        ahead: list[tuple[tuple, tuple | None]] = []
        for second, c in reversed(candidates):
            one = (second, c[1], c[2])
            two = (second, c[4], c[5]) if c[3] is not None else None
            if two is None and ahead:
                two = next((x for x in ahead[-1] if x is not None and x[1] != one[1]), None)
            ahead.append((one, two))
        ahead.reverse()
        times, out = [second for second, _ in candidates], []
        for (row_id,), (sent_at, sender) in self.asks.iterator():
            at = bisect_left(times, sent_at)
            best = None
            if at < len(times):
                one, two = ahead[at]
                best = two if sender and one[1] == sender else one
            if best is None or best[0] - sent_at > self.window:
                best = (None, None, None)
            out.append((key[0], row_id, int(sent_at), sender, *best))
        self.asks.clear()
        self.seconds.clear()
        frame = pd.DataFrame(out, columns=["group_id", "ask_row_id", "ask_at", "asker", "answer_at", "answer_sender", "text"])
        yield frame.astype({"answer_at": "Int64"})

    def close(self) -> None:
        pass


def first_answers_stream(asks: DataFrame, messages: DataFrame, window: int = fv.ANSWER_WINDOW, late: int = LATE_SECONDS) -> DataFrame:
    """Every ask once, with the first prompt-shaped text of somebody else within ``window`` seconds, or nulls.

    The streaming form of ``first_answer``: a row comes out when the watermark has passed its
    bucket's last possible answer. Candidates go to their own and the previous bucket, asks to
    their own. Needs the RocksDB state store (``STATE_STORE``).
    """
    bucket = F.floor(F.col("sent_at") / window).cast("long")
    texts = messages.withColumn("text", clean_extracted("text")).filter(looks_like_prompt("text"))
    null = F.lit(None)
    left = with_time(asks, late=late).select("group_id", bucket.alias("bucket"), F.lit(True).alias("is_ask"), "row_id", "sent_at", "sender", null.cast("long").alias("ord"), null.cast("string").alias("text"), "ts")
    right = with_time(texts, late=late).select("group_id", F.explode(F.array(bucket, bucket - 1)).alias("bucket"), F.lit(False).alias("is_ask"), null.cast("string").alias("row_id"), "sent_at", "sender", F.col("input_order").alias("ord"), "text", "ts")
    return left.unionByName(right).groupBy("group_id", "bucket").transformWithStateInPandas(
        statefulProcessor=FirstAnswers(window), outputStructType="group_id string, ask_row_id string, ask_at long, asker string, answer_at long, answer_sender string, text string", outputMode="Append", timeMode="EventTime")


def earliest_answers(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("group_id", "ask_row_id", "ask_at").agg(F.min_by(F.struct("answer_at", "answer_sender", "text"), F.struct("answer_at", "answer_order")).alias("a")).select("group_id", "ask_row_id", "ask_at", "a.*")


def merge_answers(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fold new candidate pairs into the stored first answers: (group_id, ask_row_id, ask_at,
    answer_at, answer_order, answer_sender, text). An earlier answer that comes late, in a later
    batch, replaces the stored one; folding a batch again changes nothing."""
    columns = ["group_id", "ask_row_id", "ask_at", "answer_at", "answer_order", "answer_sender", "text"]
    every = stored.select(*columns).unionByName(pairs.select(*columns))
    best = F.min_by(F.struct(*columns[3:]), F.struct("answer_at", "answer_order"))
    return every.groupBy(*columns[:3]).agg(best.alias("a")).select(*columns[:3], "a.*")


def to_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over the data available now, handing each batch to ``sink``."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MergedCoverage(StatefulProcessor):
    """Keeps the merged ranges of each key and emits them as they change.

    State is one entry per merged range, keyed by its start; a key is a (group, day), so
    even a group that holds most rows is spread over its days.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getMapState("ranges", "start_unix long", "end_unix long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = [(int(k[0]), int(v[0])) for k, v in self.ranges.iterator()]
        for frame in rows:
            spans.extend(zip(frame["start_unix"].astype("int64").tolist(), frame["end_unix"].astype("int64").tolist()))
        merged: list[list[int]] = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        self.ranges.clear()
        for start, end in merged:
            self.ranges.updateValue((start,), (end,))
        yield pd.DataFrame({"group_id": [key[0]] * len(merged), "day": [int(key[1])] * len(merged), "start_unix": [m[0] for m in merged], "end_unix": [m[1] for m in merged]})

    def close(self) -> None:
        pass


def merged_coverage_stream(ranges: DataFrame) -> DataFrame:
    """Merged coverage per (group, day) as ranges arrive. Ranges are cut at day borders; a
    batch merge of the latest rows per day joins touching days again."""
    day = 86400
    cut = ranges.withColumn("day", F.explode(F.sequence(F.floor(F.col("start_unix") / day), F.floor((F.col("end_unix") - 1) / day)))).select(
        "group_id", F.col("day").cast("long"), F.greatest("start_unix", F.col("day") * day).cast("long").alias("start_unix"), F.least("end_unix", (F.col("day") + 1) * day).cast("long").alias("end_unix"))
    return cut.groupBy("group_id", "day").transformWithStateInPandas(
        statefulProcessor=MergedCoverage(), outputStructType="group_id string, day long, start_unix long, end_unix long", outputMode="Update", timeMode="None")
