"""The bounded ask/answer stream equals the batch as-of join, also for a hot second and over several batches."""

import random

from colloquia.operators.pairing import first_answer
from colloquia.streaming import incremental as inc

ASK = "group_id string, row_id string, sent_at long, sender string"
SAID = "group_id string, sent_at long, sender string, input_order long, text string, speaker string"
PROMPT = "masterpiece, best quality, 1girl, solo, "


def test_stream_equals_first_answer(spark, tmp_path):
    rng = random.Random(4)
    asks = [("hot", f"h{i}", 50_000, f"u{i % 40}") for i in range(300)] + [("hot", f"x{i}", 50_000 + rng.randrange(4000), rng.choice(["", "u1", "u2", "u3"])) for i in range(80)]
    said = [("hot", 50_000, f"u{i % 40}", i, PROMPT + str(i), "s") for i in range(300)] + [("hot", 50_000 + rng.randrange(6000), rng.choice(["", "u1", "u2"]), 1000 + i, (PROMPT if i % 3 else "chat ") + str(i), "s") for i in range(120)]
    asks += [("quiet", "q1", 100, "a"), ("quiet", "q2", 1799, "a"), ("quiet", "q3", 9000, "a")]
    said += [("quiet", 1900, "a", 1, PROMPT, "s"), ("quiet", 1900, "b", 2, PROMPT + "b", "s"), ("quiet", 3599, "c", 3, PROMPT + "c", "s")]
    batches = [(asks[:200], said[:260]), (asks[200:], said[260:])]
    end = 10**6
    folders = {}
    for n, (a, m) in enumerate([*batches, ([("zz", "end", end, "")], [("zz", end, "z", 0, PROMPT, "s")])]):
        spark.createDataFrame(a, ASK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asks")
        spark.createDataFrame(m, SAID).coalesce(1).write.mode("append").parquet(f"{tmp_path}/said")
        rows = folders.setdefault("rows", [])
        left = spark.readStream.schema(ASK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/asks")
        right = spark.readStream.schema(SAID).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/said")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", inc.STATE_STORE)
        try:
            query = inc.to_batches(inc.first_answers_stream(left, right, late=60_000), lambda b, i: rows.extend(b.collect()), f"{tmp_path}/cp")
            query.awaitTermination()
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.group_id, r.ask_row_id): (r.answer_at, r.answer_sender, r.text) for r in folders["rows"]}
    assert len(got) == len(folders["rows"]) == len(asks)  # one row per ask: linear output
    frame = spark.createDataFrame(asks, ASK)
    want = {(r.group_id, r.sent_at, r.sender): (r.answer_at, r.answer_sender, r.payload and r.payload["text"]) for r in first_answer(frame, spark.createDataFrame(said, SAID)).collect()}
    assert got == {(g, i): want[g, t, s] for g, i, t, s in asks}
    assert got["quiet", "q1"] == (1900, "b", PROMPT + "b".strip()) and got["quiet", "q3"] == (None, None, None)
