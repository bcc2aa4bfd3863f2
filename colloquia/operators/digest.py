"""Digest of several groups: views, merged action and risk lists, ordered text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia.functions.values import importance_rank, to_local
from colloquia.operators.ordered import ordinal, top_per_key

NO_TEXT = "no text to summarise in this period"


def local_topic_line(topics: DataFrame) -> DataFrame:
    """Names of the three largest real topics of a group."""
    top = top_per_key(topics.filter("topic > 0 and message_count > 0"), ["group_id"], [F.col("message_count").desc(), F.col("topic").asc()], 3)
    return top.groupBy("group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), " / ").alias("topic_line"))


def group_views(header: DataFrame, topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Digest view of every group: label, counts, span and its summary line."""
    joined = header.join(local_topic_line(topics), "group_id", "left").join(summaries.select("group_id", F.col("summary").alias("_s")), "group_id", "left")
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("group_id"))
    label = F.when(name == F.col("group_id"), name).otherwise(F.concat(name, F.lit("("), "group_id", F.lit(")")))
    return joined.select("group_id", name.alias("name"), label.alias("label"), "text_messages", "media_messages", "first_local", "last_local", F.col("_s").isNotNull().alias("summarised"),
                         F.coalesce(F.nullif("_s", F.lit("")), F.nullif("topic_line", F.lit("")), F.lit(NO_TEXT)).alias("summary_line"))


def sort_groups(views: DataFrame) -> DataFrame:
    return ordinal(views.withColumn("_o", -F.col("text_messages")), [], ["_o", "group_id"], "rank").drop("_o")


def sort_actions(actions: DataFrame) -> DataFrame:
    return actions.withColumn("place", (F.col("status") == "resolved").cast("long")).orderBy("place", "group_id", "rank")


def sort_risks(risks: DataFrame) -> DataFrame:
    return risks.withColumn("place", importance_rank("severity")).orderBy("place", "group_id")


def overview(views: DataFrame) -> DataFrame:
    """Totals of the digest."""
    return views.agg(F.count(F.lit(1)).alias("group_count"), F.sum("text_messages").alias("text_messages"), F.sum("media_messages").alias("media_messages"),
                     F.count(F.when(F.col("summarised"), 1)).alias("summarised_groups"))


def overview_entries(views: DataFrame) -> DataFrame:
    """``name: summary`` of every group with its place; joined in this order they are the
    overview text. Kept as rows, however many groups there are."""
    return sort_groups(views).select("rank", "group_id", F.concat("name", F.lit(": "), "summary_line").alias("entry"))


def digest_lines(views: DataFrame, topics: DataFrame, actions: DataFrame, risks: DataFrame, links: DataFrame) -> DataFrame:
    """The digest as (section, ord, line) rows; order by them and write the lines.

    ``actions``: group_id, owner, task, status, resolution, evidence. ``risks``: group_id,
    severity, risk, evidence. ``links``: group_id, sent_at, speaker, url.
    """
    named = lambda df: df.join(views.select("group_id", "name"), "group_id")
    row = lambda df, section, order, line: df.select(F.lit(section).cast("long").alias("section"), order.alias("ord"), line.alias("line"))
    key = lambda *parts: F.concat_ws("|", *parts)
    padded = lambda c: F.lpad(c.cast("string"), 20, "0")
    head = views.agg(F.min("first_local").alias("a"), F.max("last_local").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("text_messages").alias("t"), F.sum("media_messages").alias("m"))
    top = head.select(F.posexplode(F.array(F.lit("# Group digest"), F.concat(F.lit("- Span: "), "a", F.lit(" to "), "b"), F.concat(F.lit("- Groups: "), F.col("n").cast("string")),
                                           F.concat(F.lit("- Text messages: "), F.col("t").cast("string")), F.concat(F.lit("- Media messages: "), F.col("m").cast("string")))).alias("p", "line"))
    place = lambda v: key(padded(F.lit(10 ** 12) - v), F.col("group_id"))
    counts = F.concat(F.lit("text "), F.col("text_messages").cast("string"), F.lit(", media "), F.col("media_messages").cast("string"))
    group_rows = row(views, 1, place(F.col("text_messages")), F.concat(F.lit("- "), "label", F.lit(" - "), counts, F.lit(": "), "summary_line"))
    state = F.when(F.col("status") == "resolved", "[resolved]").otherwise("[open]")
    result = F.when(F.coalesce("resolution", F.lit("")) != "", F.concat(F.lit(" | result: "), "resolution")).otherwise("")
    action_rows = row(named(actions), 2, key((F.col("status") == "resolved").cast("int").cast("string"), F.col("group_id"), F.col("task")),
                      F.concat(F.lit("- "), state, F.lit(" ["), "name", F.lit("] "), F.coalesce("owner", F.lit("nobody")), F.lit(": "), "task", result, F.lit(" | evidence: "), "evidence"))
    risk_rows = row(named(risks), 3, key(importance_rank("severity").cast("string"), F.col("group_id"), F.col("risk")), F.concat(F.lit("- ["), "name", F.lit("] "), "severity", F.lit(": "), "risk", F.lit(" | evidence: "), "evidence"))
    largest = top_per_key(topics.filter("message_count > 0"), ["group_id"], [F.col("message_count").desc(), F.col("topic").asc()], 8)
    topic_rows = row(largest.join(views.select("group_id", "text_messages"), "group_id"), 4, key(place(F.col("text_messages")), F.lit("t"), padded(F.col("rank"))), F.concat(F.lit("- "), "name", F.lit(": "), F.col("message_count").cast("string")))
    heads = row(views, 4, key(place(F.col("text_messages")), F.lit("a")), F.concat(F.lit("### "), "label"))
    last = top_per_key(links, ["group_id"], [F.col("sent_at").desc(), F.col("url").asc()], 10)
    link_rows = row(last.join(views.select("group_id", "text_messages"), "group_id"), 4, key(place(F.col("text_messages")), F.lit("u"), padded(F.lit(1000) - F.col("rank"))),
                    F.concat(F.lit("- ["), to_local("sent_at"), F.lit("] "), "speaker", F.lit(": "), "url"))
    out = top.select(F.lit(0).cast("long").alias("section"), padded(F.col("p")).alias("ord"), "line")
    for part in (group_rows, action_rows, risk_rows, heads, topic_rows, link_rows):
        out = out.unionByName(part)
    return out
