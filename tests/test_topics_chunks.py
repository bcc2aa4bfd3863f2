import json
import random
import re

import pytest

from colloquia import fixed_values as fv
from colloquia.operators import chunks as ch
from colloquia.operators import topics as tp

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa"]


def words_of(text):
    return [w for w in re.findall(r"[a-z][a-z0-9_-]{2,}|[0-9]{3,}", text) if w not in fv.STOP_WORDS]


def greedy(messages, rounds=12, important=80, size=80):
    """Straight-line topic mining of one group: (row_id, sent_at, order, text) rows."""
    count, seen = {}, {}
    for m in messages:
        for w in words_of(m[3]):
            count[w] = count.get(w, 0) + 1
        for w in set(words_of(m[3])):
            seen[w] = seen.get(w, 0) + 1
    ranked = sorted([w for w in count if seen[w] >= 2 or count[w] >= 3], key=lambda w: (-seen[w], -count[w], w))[:important]
    tokens = {m[0]: set(words_of(m[3])) & set(ranked) for m in messages}
    seeds = sorted([m for m in messages if tokens[m[0]]], key=lambda m: (-len(tokens[m[0]]), -len(m[3]), m[2]))
    used, topics = set(), []
    for s in seeds:
        if s[0] in used or len(topics) == rounds:
            continue
        scored = []
        for m in messages:
            gap = abs(m[1] - s[1])
            points = 30 * len(tokens[m[0]] & tokens[s[0]]) + (10 if gap <= 10800 else 4 if gap <= 43200 else 0)
            if points >= 30 and m[0] not in used:
                scored.append((-points, m[1], m[2], m[0]))
        best = [x[3] for x in sorted(scored)[:size]]
        if len(best) >= 2:
            used |= set(best)
            topics.append(set(best))
    return topics


def test_topics_equal_the_greedy_loop(spark):
    rng = random.Random(11)
    rows = []
    for group, size in (("a", 260), ("b", 40), ("c", 3)):
        for i in range(size):
            text = " ".join(rng.choice(WORDS) + rng.choice(["", "1", "2", "3"]) for _ in range(rng.randrange(0, 4)))
            rows.append((group, f"{group}{i}", rng.randrange(0, 400000), i, text))
    df = spark.createDataFrame(rows, "group_id string, row_id string, sent_at long, input_order long, text string")
    got = {}
    topics = tp.assign_topics(df)
    for r in topics.collect():
        got.setdefault(r.group_id, {}).setdefault(r.topic, set()).add(r.row_id)
    for group in "abc":
        want = greedy([r[1:] for r in rows if r[0] == group])
        assert [got.get(group, {})[k] for k in sorted(got.get(group, {}))] == want
    assert tp.with_residual(df, topics).count() == len(rows)


@pytest.mark.parametrize("rounds,important,size", [(4, 6, 3), (6, 70, 2), (9, 3, 5)])
def test_topics_whose_members_are_not_among_the_first_seeds(spark, rounds, important, size):
    """Far more rows than the seeds that are kept, many alike: guesses of later topics fail and are made again."""
    rng = random.Random(rounds)
    rows = []
    for group, many in (("a", 400), ("b", 90)):
        for i in range(many):
            text = " ".join(rng.choice(WORDS) + rng.choice(["", "1", "2"]) for _ in range(rng.choice([1, 1, 1, 1, 2, 3, 5])))
            rows.append((group, f"{group}{i}", rng.randrange(0, 200000), i, text))
    df = spark.createDataFrame(rows, "group_id string, row_id string, sent_at long, input_order long, text string")
    got = {}
    for r in tp.assign_topics(df, rounds, important, size).collect():
        got.setdefault(r.group_id, {}).setdefault(r.topic, set()).add(r.row_id)
    for group in "ab":
        want = greedy([r[1:] for r in rows if r[0] == group], rounds, important, size)
        assert [got[group][k] for k in sorted(got[group])] == want


def test_topics_of_no_messages_and_of_messages_without_tokens(spark):
    df = spark.createDataFrame([("a", "1", None, 0, ""), ("a", "2", 5, 1, None), (None, "3", 5, 1, "alpha beta")], "group_id string, row_id string, sent_at long, input_order long, text string")
    assert tp.assign_topics(df).collect() == []
    assert tp.assign_topics(df.limit(0)).collect() == []


def pack(lengths, n, c, limit):
    out, chunk, count, used = [], 1, 0, 0
    for x in lengths:
        if count >= n or (count and used + x + 1 > c):
            chunk, count, used = chunk + 1, 0, 0
            if chunk > limit:
                break
        out.append(chunk)
        count, used = count + 1, used + x + 1
    return out


def test_packing_equals_the_loop(spark):
    rng = random.Random(12)
    rows = [(g, f"{g}{i}", i, i, rng.randrange(1, 60)) for g in ("a", "b") for i in range(150)]
    df = spark.createDataFrame(rows, "group_id string, row_id string, sent_at long, input_order long, line_length long")
    got = {r.row_id: r.chunk for r in ch.pack_chunks(df, 7, 120, 10).collect()}
    for g in ("a", "b"):
        want = pack([r[4] for r in rows if r[0] == g], 7, 120, 10)
        assert [got[f"{g}{i}"] for i in range(len(want))] == want
        assert f"{g}{len(want)}" not in got or len(want) == 150
    cover = {r.group_id: r for r in ch.chunk_coverage(df, ch.pack_chunks(df, 7, 120, 10)).collect()}
    assert cover["a"].capped and cover["a"].mode == "mapreduce" and cover["a"].total_messages == 150


def test_packing_has_no_limit_and_spans_buckets(spark):
    rng = random.Random(3)
    rows = [(g, f"{g}{i:04d}", i, i, rng.randrange(1, 90)) for g, n in (("a", 900), ("b", 31), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "group_id string, row_id string, sent_at long, input_order long, line_length long")
    for width in (7, 10, 64, None):
        got = {r.row_id: r.chunk for r in ch.pack_chunks(df, 7, 150, bucket_lines=width).collect()}
        for g in ("a", "b", "c"):
            mine = [r for r in rows if r[0] == g]
            assert [got[r[1]] for r in mine] == pack([r[4] for r in mine], 7, 150, 10**9)
    assert max(got.values()) > 150


def test_caps_from_both_ends(spark):
    df = spark.createDataFrame([("g", str(i), i, i, 10) for i in range(10)], "group_id string, row_id string, sent_at long, input_order long, line_length long")
    assert sorted(int(r.row_id) for r in ch.cap_tail(df, 8, 33).collect()) == [7, 8, 9]
    assert sorted(int(r.row_id) for r in ch.cap_head(df, 8, 33).collect()) == [2, 3, 4]
    assert ch.cap_tail(df, 8, 1).count() == 1


def answers(spark, *docs):
    return spark.createDataFrame([("g", i + 1, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "group_id string, chunk long, answer string")


def test_summary_rules(spark):
    topic = {"title": "t", "summary": "s", "importance": "high", "messageCountEstimate": 3, "details": [], "evidence": ["e"]}
    got = [r.reason for r in ch.normalize_summary(answers(
        spark, {"summary": "x", "topics": [topic]}, {"topics": []}, {"summary": "x"}, {"summary": "x", "topics": [{**topic, "importance": "odd"}]}, "not json",
        {"summary": "x", "topics": [], "risks": [{"severity": "low", "risk": " ", "evidence": "e"}]})).orderBy("chunk").collect()]
    assert got == [None, "summary", "topics", "topic", "summary", "risk"] or got == [None, "summary", "topics", "topic", "not-json", "risk"]


def test_parts_merge_deterministically(spark):
    first = {"summary": " one ", "topics": [{"title": "A  b", "summary": "s1", "importance": "low", "messageCountEstimate": 2, "details": ["d1", "d1"], "evidence": []}],
             "actions": [{"owner": None, "task": "Do it", "status": "open", "evidence": "e1"}], "links": [{"title": "l", "url": "U", "why": "w"}], "risks": [{"severity": "low", "risk": "R", "evidence": "e"}],
             "timeline": [{"start": "1", "title": "t", "summary": "s"}], "uncategorized": [{"hkt": "1", "speaker": "p", "note": "n"}]}
    second = {"summary": "two", "topics": [{"title": "a B", "summary": "s2", "importance": "high", "messageCountEstimate": 5, "details": ["d2"], "evidence": ["e"]}, {"title": "c", "importance": "odd", "messageCountEstimate": 1}],
              "actions": [{"owner": "x", "task": "do  IT", "status": "resolved", "resolution": "done", "evidence": "e2"}, {"owner": "y", "task": "later", "status": "open", "evidence": "e3"}], "links": [{"title": "l2", "url": "u", "why": "w2"}]}
    out = ch.merge_partials(ch.normalize_summary(answers(spark, first, second)))
    topics = out["topics"].orderBy("rank").collect()
    assert [(t.title, t.summary, t.importance, t.message_count_estimate, t.details, t.evidence) for t in topics] == [("A  b", "s1", "high", 7.0, ["d1", "d2"], ["e"]), ("c", "c", "medium", 1.0, [], [])]
    assert [(a.task, a.status, a.resolution, a.owner) for a in out["actions"].orderBy("rank").collect()] == [("later", "open", None, "y"), ("Do it", "resolved", "done", None)]
    assert [x.title for x in out["links"].collect()] == ["l"] and out["summary"].first().summary == "one two"
    assert out["risks"].count() == 1 and out["timeline"].count() == 1 and out["uncategorized"].count() == 1


def test_answers_of_short_texts_equal_the_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["", " ", "one", "two words", "  leads", "tail  ", "a \n b", "\t \n", "three whole words", " " * 250 + "late", None]
    rows = [(i * 7 + j, turn, "user", text) for i, text in enumerate(texts) for j in range(7) for turn in (0, 1, 2, 3, 4, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = entry.queries()["normalize_summary"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in got.collect()} == set(con.execute(entry.oracle_sql()["normalize_summary"]).fetchall())


def test_requests_move_a_shared_text_once_to_a_part(spark):
    bodies = spark.createDataFrame([(0, "\"zero\" \u2028 text"), (1, "one"), (2, None)], "body_id long, body string")
    said = [("g" if i % 3 else "h", str(i), 100 + i, i, "S", i % 4) for i in range(60)]
    messages = spark.createDataFrame(said, "group_id string, row_id string, sent_at long, input_order long, speaker string, body_id long")
    names = spark.createDataFrame([("g", "G"), ("h", "")], "group_id string, name string")
    lines = ch.line_heads(messages, names, bodies)
    whole = {r.row_id: r for r in ch.summary_lines(messages.join(bodies, "body_id", "left").selectExpr("*", "coalesce(body, '') as text"), names).collect()}
    assert {r.row_id: r.line_length for r in lines.collect()} == {k: r.line_length for k, r in whole.items()}
    packed = ch.pack_chunks(lines, 7, 200)
    header = spark.createDataFrame([("g", "a", "b", 40, 0)], "group_id string, first_local string, last_local string, text_messages long, media_messages long")
    topics = spark.createDataFrame([("g", 1, "t", 3, "a:2,b:1")], "group_id string, topic long, name string, message_count long, keywords string")
    blocks = spark.createDataFrame([("h", 100, 160, 20)], "group_id string, start_unix long, end_unix long, message_count long")
    got = {p: sorted(map(tuple, ch.summary_requests(lines, packed, header, topics, blocks, bodies, p).collect())) for p in (100, 1 << 25)}
    assert got[100] == got[1 << 25] and len(got[100]) > 8
    order = {}
    for r in packed.collect():
        order.setdefault((r.group_id, r.chunk), []).append((r.line_no, whole[r.row_id].line))
    for group, chunk, parts, count, request in got[100]:
        asked = json.loads(request)
        assert asked["messages"] == [line for _, line in sorted(order[group, chunk])] and count == len(asked["messages"])
        assert list(asked) == ["part", "parts", "context", "messages"] and asked["part"] == chunk and asked["parts"] == parts == max(c for g, c in order if g == group)
        assert set(asked["context"]) == ({"first_local", "last_local", "text_messages", "media_messages", "topics"} if group == "g" else {"blocks"})


def test_leading_tokens_are_exact_for_any_cells(spark):
    from colloquia.operators import content as ct

    dice = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    said = [(dice.choice(["g", "h", None]), dice.choice([1, 2]), " ".join(vocabulary[int(300 * dice.random() ** 3)] for _ in range(dice.choice([1, 30])))) for _ in range(200)] + [("few", 1, "alone"), ("few", 1, "alone")]
    messages = spark.createDataFrame(said, "group_id string, topic long, text string")
    by = ["group_id", "topic"]
    want = sorted(map(repr, ct.top_tokens(messages, 5, by).select(*by, "token", "messages", "count", "token_rank").collect()))
    for cells, first, most in ((64, 16, 1 << 18), (64, 4, 1 << 18), (4, 1, 1 << 18), (4096, 256, 1 << 18), (64, 16, 1)):
        got = ct.leading_tokens(messages, 5, by, cells, first, most).select(*by, "token", "messages", "count", "token_rank").collect()
        assert sorted(map(repr, got)) == want


def test_heads_not_texts_are_sorted_for_the_name_of_a_topic(spark):
    from colloquia.plans import views
    from colloquia.plans.content_queries import members

    text = tp.topic_names(members(spark, "/root/testdata/sf0.001", views.tokened))._jdf.queryExecution().executedPlan().toString()
    picking = [line for line in text.splitlines() if "min_by(" in line]
    assert picking and not any("regexp_replace" in line or "text#" in line for line in picking)


def test_user_summariser_failures_stay_local(spark):
    requests = spark.createDataFrame([("g", 1, "ok"), ("g", 2, "bad")], "group_id string, chunk long, request string")

    def fn(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    assert sorted(tuple(r) for r in ch.summarize_with(requests, fn).fillna("-").collect()) == [("g", 1, "OK", "-"), ("g", 2, "-", "no")]


def test_short_summary(spark):
    row = ch.quick_summary(answers(spark, {"summary": "s", "points": [str(i) for i in range(20)], "actions": [{"text": ""}, {"text": "a", "status": "resolved"}]})).first()
    assert len(row.points) == 12 and [(a.text, a.status, a.resolution) for a in row.actions] == [("a", "resolved", "")]


def test_buckets_of_a_hot_group_are_composed(spark):
    """One group in hundreds of buckets and others in one: chunks as by a straight loop, and no task takes a whole group."""
    import random

    from colloquia.operators import chunks as ch
    rng = random.Random(8)
    rows = [("hot", str(i), i, i, rng.choice([1, 5, 30, 90, 300])) for i in range(2500)] + [("cold", str(i), i, i, 7) for i in range(9)] + [("edge", str(i), i, i, 3) for i in range(33)]
    frame = spark.createDataFrame(rows, "group_id string, row_id string, sent_at long, input_order long, line_length long")
    want, state = {}, {}
    for group, row, _, _, length in rows:
        chunk, lines, used = state.get(group, (0, 0, 0))
        if not chunk or lines == 8 or used + length + 1 > 200:
            chunk, lines, used = chunk + 1, 0, 0
        state[group] = (chunk, lines + 1, used + length + 1)
        want[group, row] = chunk
    for width in (8, 32):
        packed = ch.pack_chunks(frame, 8, 200, bucket_lines=width)
        assert {(r.group_id, r.row_id): r.chunk for r in packed.collect()} == want
        assert packed._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
