"""Greedy topic mining: all groups advance together, several topics per pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import counts_of, text_head
from colloquia.operators import greedy
from colloquia.operators.content import last_n, top_tokens
from colloquia.operators.ordered import top_per_key
from colloquia.session import durable, few

IMPORTANT_TOKENS, TOPIC_SIZE, MAX_TOPICS = 80, 80, 12
FEW_GROUPS = 1 << 13  # whose lists of important tokens are broadcast: some 4 kB each


def important_tokens(messages: DataFrame) -> DataFrame:
    return top_tokens(messages, IMPORTANT_TOKENS).select("group_id", "token", "token_rank")


def marked(messages: DataFrame, important: DataFrame) -> DataFrame:
    """Messages holding important tokens, with those tokens (at most 80 per group) as an array.
    The lists go to the messages: all the tokens of a message would have to go to its list."""
    listed = few(durable(important.groupBy("group_id").agg(F.collect_set("token").alias("_important"))), FEW_GROUPS)
    kept = F.array_intersect(F.transform(counts_of(messages), lambda t: t["token"]), F.col("_important"))
    return messages.join(listed, "group_id").select(
        "group_id", "row_id", "sent_at", "input_order", F.length("text").alias("text_length"), kept.alias("tokens")).filter(F.size("tokens") > 0)


def incidence(messages: DataFrame, important: DataFrame) -> DataFrame:
    """Distinct (message, important token) pairs."""
    return marked(messages, important).select("group_id", "row_id", F.explode("tokens").alias("token"))


def seed_order(rows: DataFrame) -> DataFrame:
    """Seed key of every marked message: most tokens, longest text, input order."""
    key = F.struct((-F.size("tokens")).alias("a"), (-F.col("text_length")).alias("b"), F.col("input_order").alias("c"))
    return rows.withColumn("token_count", F.size("tokens").cast("long")).withColumn("seed_key", key)


def time_score(distance: Column) -> Column:
    """Nearness bonus in tenths of a point, to keep scores exact."""
    return F.when(distance <= 3 * 3600, 10).when(distance <= 12 * 3600, 4).otherwise(0)


def score(seeds: DataFrame, rows: DataFrame) -> DataFrame:
    """Score (tenths of a point) of every message sharing a token with its group's seed.
    ``seeds``: group_id, seed_tokens, seed_at; one row per group."""
    overlap = F.size(F.array_intersect("tokens", "seed_tokens"))
    scored = rows.join(seeds, "group_id").withColumn("overlap", overlap).filter("overlap > 0")
    return scored.select("group_id", "row_id", "sent_at", "input_order",
                         (F.col("overlap") * 30 + time_score(F.abs(F.col("sent_at") - F.col("seed_at")))).cast("long").alias("score"))


def token_masks(messages: DataFrame, important: DataFrame, words: list[str]) -> DataFrame:
    """Messages holding important tokens, as bit masks over the ranks of those tokens, without their text.
    ``important``: group_id, listed (the tokens of a group in rank order), cut."""
    places = F.transform(F.array_intersect(F.transform(counts_of(messages), lambda t: t["token"]), F.col("listed")), lambda t: F.array_position("listed", t).cast("int") - 1)
    one = F.lit(1).cast("long")
    mask = lambda i: F.aggregate("_places", F.lit(0).cast("long"), lambda acc, p: acc + F.when(
        F.floor(p / greedy.WORD) == i, F.call_function("shiftleft", one, p % greedy.WORD)).otherwise(F.lit(0).cast("long")))
    placed = messages.join(few(important, FEW_GROUPS), "group_id").select(
        "group_id", "row_id", "sent_at", "input_order", F.length("text").cast("long").alias("text_length"),
        F.explode(F.array(places)).alias("_places")).filter(F.size("_places") > 0)  # a generator: the filter must not compute the tokens again
    return placed.select("group_id", "row_id", "sent_at", "input_order", "text_length", *[mask(i).alias(w) for i, w in enumerate(words)])


def best_of_plan(rows: DataFrame, plan: DataFrame, words: list[str], longest: int) -> DataFrame:
    """The best-scored rows of every planned seed (``need`` of them, in order), used rows included."""
    seeds = plan.select("group_id", "number", F.col("sent_at").alias("_at"), F.col("score").alias("_bound"), F.col("need").alias("_need"),
                        *[F.col(w).alias(f"_{w}") for w in words])
    overlap = sum((F.bit_count(F.col(w).bitwiseAND(F.col(f"_{w}"))) for w in words[1:]), F.bit_count(F.col(words[0]).bitwiseAND(F.col(f"_{words[0]}"))))
    points = (overlap * 30 + time_score(F.abs(F.col("sent_at") - F.col("_at")))).cast("long")
    scored = rows.join(few(seeds, FEW_GROUPS * MAX_TOPICS), "group_id").filter((overlap > 0) & (points >= F.col("_bound"))).withColumn("score", points)
    order = [F.col("score").desc(), F.col("sent_at").asc(), F.col("input_order").asc(), F.col("row_id").asc()]
    return top_per_key(scored, ["group_id", "number"], order, longest, "need").filter("need <= _need").withColumn("kind", F.lit("listed"))


def assign_topics(messages: DataFrame, rounds: int = MAX_TOPICS, important: int = IMPORTANT_TOKENS, size: int = TOPIC_SIZE, ranked: DataFrame | None = None) -> DataFrame:
    """(group_id, topic, row_id): members of every group's greedy topics. ``ranked``: the ``important`` leading tokens of the groups, if known.

    A seed can found a topic exactly when it is unused and shares a token with another unused
    message. Before the last topic at most ``(rounds - 1) * size`` rows are used, and seeds passed
    over for want of a partner hold disjoint tokens, so they are at most ``important``: the first
    ``rounds * (size + 1) + important`` seeds of a group contain all that are ever taken.

    Each pass guesses the remaining topics from those seeds alone, finds the best rows of all
    guessed seeds in one scan of the slim rows, and takes topics in order while the guesses hold
    (``greedy.topic_step``). The first guess of a pass is always right, so there are at most
    ``rounds`` passes; usually two or three. A group's extract is bounded by the three numbers,
    whatever the group's size, and groups that are done leave.
    """
    words = greedy.word_names(important)
    state = [c.split()[0] for c in greedy.state_schema(important).split(", ")]
    zero = F.lit(0).cast("long")
    ranked = top_tokens(messages, important) if ranked is None else ranked
    listed = durable(ranked.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("token_rank", "token", "messages"))).alias("t")))
    rows = durable(token_masks(messages, listed.select("group_id", F.col("t.token").alias("listed")), words))
    held = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    seeds = top_per_key(rows, ["group_id"], [held.desc(), F.col("text_length").desc(), F.col("input_order").asc(), F.col("row_id").asc()],
                        rounds * (size + 1) + important, "number")
    shaped = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*[
        F.col(c) if c in (*df.columns, "kind") else (F.lit("") if c == "row_id" else zero).alias(c) for c in state])
    counts = listed.select("group_id", F.posexplode("t").alias("number", "t")).select("group_id", F.col("number").cast("long").alias("number"), F.col("t.messages").alias("score"))
    fixed = durable(shaped(seeds, "seed").unionByName(shaped(counts, "count")))
    step, schema = greedy.topic_step(important, rounds, size), greedy.state_schema(important)
    known, found = fixed, None
    while True:
        turn = durable(known.groupBy("group_id").applyInPandas(step, schema))
        found = turn.filter("kind <> 'plan'") if found is None else found.unionByName(turn.filter("kind <> 'plan'"))
        plan = turn.filter("kind = 'plan'")
        if plan.isEmpty():
            break
        known = fixed.unionByName(found).join(plan.select("group_id").distinct(), "group_id", "left_semi").unionByName(
            best_of_plan(rows, plan, words, size * rounds).select(*state))
    return found.filter("kind = 'member'").select("group_id", F.col("number").alias("topic"), "row_id")


def with_residual(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic members plus the leftover messages as topic 0."""
    rest = messages.select("group_id", "row_id").join(topics, ["group_id", "row_id"], "left_anti").select("group_id", F.lit(0).cast("long").alias("topic"), "row_id")
    return topics.select("group_id", "topic", "row_id").unionByName(rest)


def topic_names(members: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Top four topic-local tokens, else the head of the first text, else a constant.
    ``members``: group_id, topic, sent_at, input_order, text (or a ready ``head``); ``ranked``: their leading tokens, if known."""
    by = ["group_id", "topic"]
    ranked = top_tokens(members, 4, by) if ranked is None else ranked
    top = ranked.filter("token_rank <= 4").groupBy(*by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_rank", "token"))), lambda s: s["token"]), " / ").alias("_name"))
    # heads are cut before rows are sorted for their first, so that no text is
    head = F.col("head") if "head" in members.columns else F.explode(F.array(text_head("text")))
    first = members.select(*by, "sent_at", "input_order", head.alias("_cut")).groupBy(*by).agg(F.min_by("_cut", F.struct("sent_at", "input_order")).alias("_head"))
    fallback = F.when(F.col("_head") != "", F.concat(F.lit(fv.TOPIC_PREFIX), F.col("_head"))).otherwise(fv.UNNAMED_TOPIC)
    return first.join(top, by, "left").select(*by, F.when(F.col("topic") == 0, fv.MISC_TOPIC).otherwise(F.coalesce("_name", fallback)).alias("name"))


def topic_summary(members: DataFrame, speakers: int = 8, keywords: int = 10, ranked: DataFrame | None = None) -> DataFrame:
    """Count, span, top speakers and keywords of each topic; every token of a topic is counted. ``ranked``: the leading tokens, if known."""
    by = ["group_id", "topic"]
    joined = lambda df, item, n: df.groupBy(*by).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", item, n))), lambda s: F.concat(s[item], F.lit(":"), s[n].cast("string"))), ",").alias(f"{item}s"))
    people = durable(members.groupBy(*by, "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("sent_at").alias("a"), F.max("sent_at").alias("b")))
    top = joined(top_per_key(people, by, [F.col("n").desc(), F.col("speaker").asc()], speakers), "speaker", "n")
    ranked = top_tokens(members, keywords, by) if ranked is None else ranked
    words = joined(ranked.filter(F.col("token_rank") <= keywords).withColumnRenamed("token_rank", "rank"), "token", "messages")
    base = people.groupBy(*by).agg(F.sum("n").alias("message_count"), F.min("a").alias("first_unix"), F.max("b").alias("last_unix"))
    return base.join(top, by, "left").join(words, by, "left").select(
        *by, "message_count", "first_unix", "last_unix", F.coalesce("speakers", F.lit("")).alias("top_speakers"), F.coalesce("tokens", F.lit("")).alias("keywords"))


def topic_samples(members: DataFrame, n: int = 40) -> DataFrame:
    return last_n(members, ["group_id", "topic"], n)
