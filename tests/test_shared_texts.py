"""Tokens of texts that many messages show: counted whole, moved once a text."""

import random

import pytest

from colloquia.operators import content as ct
from colloquia.operators import topics as tp
from colloquia.plans import views
from colloquia.plans.catalogue import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved_by_group(df):
    """Shuffles by group that carry token lists of messages."""
    lines = plan(df).splitlines()
    return [line for line, below in zip(lines, lines[1:]) if "hashpartitioning(group_id" in line and "token_counts" in below]


@pytest.mark.parametrize("most", [256, 2])
def test_shared_token_stats_equal_those_of_the_messages(spark, most):
    dice = random.Random(7)
    words = [f"word{i}" for i in range(60)] + ["显卡", "The"]
    texts = [(i, " ".join(words[int(62 * dice.random() ** 2)] for _ in range(dice.choice([0, 1, 12, 40])))) for i in range(30)] + [(30, None), (31, "lonely lonely lonely"), (99, "never shown")]
    said = [(dice.choice(["g", "h", "", None]), dice.choice([1, 2, None]), dice.choice([*range(34), None])) for _ in range(400)] + [(f"g{i}", 1, 3) for i in range(9)]
    shown = spark.createDataFrame(said, "group_id string, topic long, text_id long")
    bodies = spark.createDataFrame(texts, "text_id long, text string")
    whole = shown.join(bodies, "text_id", "left")
    for by in (["group_id"], ["group_id", "topic"]):
        columns = [*by, "token", "count", "messages"]
        want = sorted(map(repr, ct.token_stats(whole, by).select(*columns).collect()))
        got = ct.shared_token_stats(shown, bodies, by, most)
        assert sorted(map(repr, got.select(*columns).collect())) == want and len(want) > 100
        assert sorted(map(repr, ct.shared_top_tokens(shown, bodies, 5, by).select(*columns, "token_rank").collect())) == sorted(
            map(repr, ct.top_tokens(whole, 5, by).select(*columns, "token_rank").collect()))
    assert ct.shared_token_stats(shown.limit(0), bodies).collect() == []


def test_a_token_moves_once_a_text_and_not_once_a_group(spark):
    text = plan(ct.shared_token_stats(*views.shown(spark, SMALL)))
    assert [line for line in text.splitlines() if "Exchange" in line and "token" in line] and "_number#" in text
    assert all("hashpartitioning(token" in line for line in text.splitlines() if "Exchange" in line and "token" in line)


def test_the_words_of_a_message_stay_where_they_are_for_its_topics(spark):
    messages = views.tokened(spark, SMALL)
    found = tp.marked(messages, ct.shared_top_tokens(*views.shown(spark, SMALL)))
    assert not moved_by_group(found) and "hashpartitioning(group_id" not in plan(found)
    several = tp.marked(messages.limit(50), ct.shared_top_tokens(*views.shown(spark, SMALL)))
    assert several.count() > 0


def test_lists_of_many_groups_are_not_broadcast(spark, monkeypatch):
    messages, few = views.tokened(spark, SMALL), ct.shared_top_tokens(*views.shown(spark, SMALL))
    want = sorted(map(repr, tp.incidence(messages, few).collect()))
    topics = sorted(map(repr, tp.assign_topics(messages, ranked=few).collect()))
    monkeypatch.setattr(tp, "FEW_GROUPS", 0)
    found = tp.incidence(messages, few)
    assert "hashpartitioning(group_id" in plan(found) and sorted(map(repr, found.collect())) == want
    assert sorted(map(repr, tp.assign_topics(messages, ranked=few).collect())) == topics


@pytest.mark.parametrize("name", ["incidence", "seed_order"])
def test_no_query_moves_token_lists_by_group(spark, name):
    assert "hashpartitioning(group_id" not in plan(QUERIES[name](spark, SMALL))


def test_topic_score_moves_marked_messages_only(spark):
    text = plan(QUERIES["topic_score"](spark, SMALL))
    assert "hashpartitioning(group_id" in text and "hashpartitioning(group_id#" not in text.split("array_intersect")[-1].split("Exchange hashpartitioning(doc_id")[0]


def test_every_token_of_a_topic_is_counted(spark, monkeypatch):
    """Keywords by a plain count over many equally rare tokens, by the operator and by the registered queries."""
    def skipping(*_, **__):
        raise AssertionError("tokens would be left out")

    monkeypatch.setattr(ct, "leading_tokens", skipping)
    monkeypatch.setattr(tp, "leading_tokens", skipping, raising=False)
    dice = random.Random(3)
    said = [("g", dice.choice([1, 2]), "p", i, i, " ".join({f"rare{dice.randrange(3000):04d}" for _ in range(60)})) for i in range(200)]
    messages = spark.createDataFrame(said, "group_id string, topic long, speaker string, sent_at long, input_order long, text string")
    got = {r.topic: r.keywords for r in tp.topic_summary(messages).collect()}
    names = {r.topic: r.name for r in tp.topic_names(messages).collect()}
    for topic in (1, 2):
        seen = {}
        for row in said:
            for word in row[5].split() if row[1] == topic else ():
                seen[word] = seen.get(word, 0) + 1
        best = sorted((-n, w) for w, n in seen.items() if n >= 2)[:10]
        assert got[topic] == ",".join(f"{w}:{-n}" for n, w in best) and names[topic] == " / ".join(w for _, w in best[:4])
    assert QUERIES["topic_summary"](spark, SMALL).count() == QUERIES["topic_names"](spark, SMALL).count() > 50
    assert QUERIES["group_views"](spark, SMALL).count() > 10
