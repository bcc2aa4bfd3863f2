"""Pairs requests with the answer given and the image meant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.asks import classify_ask, looks_like_prompt
from colloquia.functions.rules import read_rules
from colloquia.functions.text import clean_extracted
from colloquia.operators.media import image_owners
from colloquia.operators.ordered import first_after, recent_before
from colloquia.session import durable


def find_asks(messages: DataFrame, quotes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Messages that ask, with intent, rule and the first quoted hash if they quote. ``rules``: see ``functions.rules``."""
    quoted = quotes.select("group_id", "row_id", F.get("quoted_hashes", F.lit(0)).alias("quoted_hash"), F.lit(True).alias("_q"))
    known = read_rules(rules, "ask")
    # both verdicts come before the join, so only messages that may ask are shuffled, not every text; generators: computed once, and no filter moves in front
    bare, beside = (F.explode(F.array(classify_ask("text", F.lit(q), known))) for q in (False, True))
    may = messages.withColumn("_beside", beside).filter("_beside is not null").withColumn("_bare", bare)
    joined = may.select("group_id", "row_id", "sent_at", "sender", "speaker", "input_order", "text", "_bare", "_beside").join(quoted, ["group_id", "row_id"], "left")
    return joined.withColumn("_v", F.when(F.col("_q"), F.col("_beside")).otherwise(F.col("_bare"))).filter("_v is not null").select(
        "group_id", "row_id", "sent_at", "sender", "speaker", "input_order", clean_extracted("text").alias("ask_text"), "_v.intent", "_v.rule", "quoted_hash")


def text_candidates(messages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    cleaned = messages.withColumn("text", clean_extracted("text")).filter(looks_like_prompt("text", read_rules(rules, "answer")))
    return cleaned.select("group_id", "sent_at", F.col("input_order").alias("ord"), "sender", F.struct("speaker", "text").alias("payload"))


def media_candidates(refs: DataFrame) -> DataFrame:
    """Messages with at least one usable image or file. Refs are one row each; a message's
    own refs are few."""
    usable = refs.filter(F.col("kind").isin("image", "file") & (F.lower("hash").rlike("^[a-f0-9]{32}$") | (F.trim("file_name") != "")))
    ref = F.struct("kind", F.lower("hash").alias("hash"), F.trim("file_name").alias("file_name"))
    return usable.groupBy("group_id", "row_id", "sent_at", "input_order", "sender", "speaker").agg(F.sort_array(F.collect_list(ref)).alias("media")).select(
        "group_id", "sent_at", F.col("input_order").alias("ord"), "sender", F.struct("speaker", "media").alias("payload"))


def first_answer(asks: DataFrame, messages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """First prompt-shaped text of somebody else within half an hour."""
    return first_after(asks.select("group_id", "sent_at", "sender"), text_candidates(messages, rules), fv.ANSWER_WINDOW)


def first_media_answer(asks: DataFrame, refs: DataFrame) -> DataFrame:
    """First image or file of somebody else within two minutes."""
    return first_after(asks.select("group_id", "sent_at", "sender"), media_candidates(refs), fv.ORIGINAL_ANSWER_WINDOW)


def pair_requests(messages: DataFrame, refs: DataFrame, quotes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per ask, answered or not, with the target image and how it was found.

    Every lookup is an as-of window over reduced rows; asks and candidates of a busy group
    are never paired with each other. Asks and image owners are small next to the messages
    and used several times, so they are cut once and the texts are read only twice.
    """
    asks = durable(find_asks(messages, quotes, rules))
    at = ["group_id", "sent_at", "sender"]
    texts = first_answer(asks.filter("intent = 'prompt'"), messages, rules).select(
        *at, F.lit("prompt").alias("intent"), "answer_at", "answer_sender", F.col("payload.speaker").alias("answer_by"), F.col("payload.text").alias("answer_text"))
    shown = first_media_answer(asks.filter("intent = 'original'"), refs).select(
        *at, F.lit("original").alias("intent"), "answer_at", "answer_sender", F.col("payload.speaker").alias("answer_by"), F.col("payload.media").alias("answer_media"))
    answered = durable(asks.join(texts.unionByName(shown, allowMissingColumns=True), [*at, "intent"], "left"))

    owners = durable(image_owners(refs))
    image = F.struct("hash", "speaker", "sent_at", "sender")
    posted = owners.select("group_id", "sender", "sent_at", F.col("input_order").alias("ord"), image.alias("payload"))
    by_author = answered.filter("intent = 'prompt' and quoted_hash is null and answer_sender <> ''")
    author = recent_before(by_author.select("group_id", F.col("answer_sender").alias("sender"), "sent_at"), posted, ["group_id", "sender"], fv.AUTHOR_WINDOW).select(
        "group_id", F.col("sender").alias("answer_sender"), "sent_at", F.col("n_before").alias("author_count"), F.col("latest").alias("author_image"))
    nearby = recent_before(answered.filter("quoted_hash is null").select("group_id", "sent_at"), posted, ["group_id"], fv.GUESS_WINDOW).select(
        "group_id", "sent_at", F.col("n_before").alias("near_count"), F.col("latest").alias("near_image"))
    known = owners.select(F.col("hash").alias("quoted_hash"), image.alias("quoted_image"))
    facts = (answered.join(known, "quoted_hash", "left").join(author, ["group_id", "answer_sender", "sent_at"], "left").join(nearby, ["group_id", "sent_at"], "left"))

    found = lambda i, via, level: F.struct(i.alias("image"), F.lit(via).alias("via"), F.lit(level).alias("confidence"))
    unknown = F.struct(F.col("quoted_hash").alias("hash"), F.lit("").alias("speaker"), F.lit(0).cast("long").alias("sent_at"), F.lit("").alias("sender"))
    use_author = (F.col("intent") == "prompt") & F.col("quoted_hash").isNull()
    target = (F.when(F.col("quoted_image").isNotNull(), found(F.col("quoted_image"), "quote", "high"))
              .when(F.col("quoted_hash").isNotNull(), found(unknown, "quote-unresolved", "medium"))
              .when(use_author & (F.col("author_count") == 1), found(F.col("author_image"), "answer-author", "medium"))
              .when(use_author & (F.col("author_count") > 1), found(F.col("author_image"), "answer-author-multiple", "low"))
              .when(F.col("near_count") == 1, found(F.col("near_image"), "recent-unambiguous", "low")))
    owner = F.col("t.image.sender")
    same = (F.coalesce("answer_sender", F.lit("")) != "") & (F.col("answer_sender") == owner)
    against = (F.col("intent") == "prompt") & F.col("answer_at").isNotNull() & (F.col("t.confidence") == "low") & (owner != "") & ~same
    judged = facts.withColumn("t", target).withColumn("_against", F.coalesce(against, F.lit(False))).withColumn("e", F.when(~F.col("_against"), F.col("t")))
    has_answer = F.col("answer_at").isNotNull()
    return judged.select(
        "group_id", F.col("row_id").alias("ask_row_id"), F.col("sent_at").alias("ask_sent_at"), F.col("speaker").alias("asker"), "ask_text", "intent", "rule",
        F.col("e.image.hash").alias("image_hash"), F.coalesce("e.image.speaker", F.lit("")).alias("image_owner"), F.coalesce("e.image.sent_at", F.lit(0)).cast("long").alias("image_sent_at"),
        F.coalesce("e.via", F.when(F.col("_against"), "guess-contradicted").otherwise("none")).alias("target_via"), F.coalesce("e.confidence", F.lit("none")).alias("confidence"),
        F.when(~has_answer, "").when(F.col("intent") == "original", "media").otherwise("text").alias("answer_kind"),
        F.coalesce("answer_text", F.lit("")).alias("answer_text"), F.coalesce("answer_media", F.array()).alias("answer_media"),
        F.coalesce("answer_by", F.lit("")).alias("answer_by"), F.coalesce("answer_at", F.lit(0)).cast("long").alias("answer_sent_at"))


def withdrawn(pairs: DataFrame) -> DataFrame:
    """Requests whose guessed target the answer contradicted."""
    return pairs.filter("target_via = 'guess-contradicted'")
