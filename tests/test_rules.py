import random

import pytest
from pyspark.sql import functions as F

from colloquia.functions import asks
from colloquia.functions import rules as ru
from colloquia.operators import content, pairing

SCHEMA = "group_id string, row_id string, sent_at long, input_order long, text string"


def test_signals_equal_substring_tests(spark):
    """Words inside words, words of several signals, words with and without case, null and empty texts."""
    words = [("plain", "Fail", "a"), ("plain", "报错", "a"), ("folded", "fail", "b"), ("folded", "ailing", "c"), ("plain", "failing", "c"), ("folded", "报", "d"), ("plain", "X", "d"), ("plain", "404", "a")]
    rng = random.Random(3)
    pieces = ["Fail", "fail", "FAILING", "failing", "报错", "报", "x", "X", "404", "İ", " ", "zz", "ing"]
    rows = [("g", str(i), i, i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 5)))) for i in range(300)] + [("g", "none", 1, 1, None)]
    table = ru.rule_table(spark, [ru.Rule("signal", i, *w) for i, w in enumerate(words)])
    got = {(r.row_id, r.signal) for r in content.signals(spark.createDataFrame(rows, SCHEMA).repartition(3), 1000, table).collect()}
    want = {(row, signal) for _, row, _, _, text in rows for kind, word, signal in words if text and word in (text if kind == "plain" else text.lower())}
    assert got == want and len(want) > 200
    none = ru.rule_table(spark, [ru.Rule("ask", 0, "comment", "x", "")])
    assert content.signals(spark.createDataFrame(rows, SCHEMA), rules=none).collect() == []


def test_asks_and_answers_by_table(spark):
    table = ru.rule_table(spark, [
        ru.Rule("ask", 2, "exact", "^give it$", "original"), ru.Rule("ask", 1, "exact", "^give", "prompt"), ru.Rule("ask", 3, "short", "t", "original"),
        ru.Rule("ask", 4, "contextual", "please", "prompt"), ru.Rule("ask", 5, "comment", "no thanks|no need", ""),
        ru.Rule("answer", 1, "vocabulary", "(?i)castle", ""), ru.Rule("answer", 2, "vocabulary", "(?i)forest", "")])
    ask, answer = ru.read_rules(table, "ask"), ru.read_rules(table, "answer")
    rows = [("give it", False), ("kkt", False), ("kko", False), ("please", True), ("please", False), ("please no need", True), ("原图", False), (None, True)]
    df = spark.createDataFrame(rows, "text string, q boolean").coalesce(1)
    got = [None if r.v is None else tuple(r.v) for r in df.select(asks.classify_ask("text", F.col("q"), ask).alias("v")).collect()]
    # the lower position wins; a short code without a rule has no intent; no comment rule is lost
    assert got == [("prompt", "exact"), ("original", "kk:t"), (None, "kk:o"), ("prompt", "contextual"), None, None, None, None]
    texts = [("castle, forest, old road, night sky, tower", True), ("castle, old road, night sky, tower, gate", False), ("castle, forest", False), ("", False)]
    shaped = spark.createDataFrame(texts, "text string, want boolean").select("want", asks.looks_like_prompt("text", answer).alias("got")).collect()
    assert all(bool(r.got) == r.want for r in shaped)
    messages = spark.createDataFrame([("g", "1", 100, 0, "give it", "ann", "ann"), ("g", "2", 160, 1, texts[0][0], "bo", "bo")], SCHEMA + ", sender string, speaker string")
    refs = spark.createDataFrame([], "group_id string, row_id string, sent_at long, input_order long, sender string, speaker string, kind string, hash string, file_name string")
    quotes = spark.createDataFrame([], "group_id string, row_id string, quoted_hashes array<string>")
    (pair,) = pairing.pair_requests(messages, refs, quotes, table).collect()
    assert (pair.ask_row_id, pair.intent, pair.answer_by, pair.answer_text) == ("1", "prompt", "bo", texts[0][0])


def test_tables_that_are_not_rules(spark):
    wrong = ru.rule_table(spark, [ru.Rule("signal", 0, "exact", "x", "y")])
    empty = ru.rule_table(spark, [ru.Rule("signal", 0, "plain", "", "y")])
    for table in (wrong, empty):
        with pytest.raises(ValueError, match="not a rule"):
            ru.read_rules(table, "signal")
    with pytest.raises(ValueError, match="more than 3"):
        ru.read_rules(ru.rule_table(spark), "ask", most=3)
    assert ru.read_rules(ru.rule_table(spark), "ask") == ru.default_rules("ask")
    assert ru.read_rules(wrong, "answer") == []
