import random

from colloquia.operators import inbox as ib


def straight(rows, marks):
    """Breaks of one group's ordered (sent_at, row_id, speaker) rows."""
    out, bubble, before = {}, 0, None
    for at, row, who in rows:
        day = before is None or (at + 28800) // 86400 != (before[0] + 28800) // 86400
        divider = marks is not None and at > marks and (before is None or before[0] <= marks)
        new = day or divider or before[1] != who or at - before[0] >= 300
        bubble += new
        out[row] = (day, divider, new, bubble)
        before = (at, who)
    return out


def test_segments_equal_a_loop_wherever_partitions_are_cut(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(0, 400000), f"r{i}", rng.choice(["ann", "bo", None])) for i in range(3000)]
    rows += [("hot", 500000, f"same{i}", "ann") for i in range(40)]  # ties in time
    rows += [("calm", 7, "one", "cy"), ("late", 90000, "a", "x"), ("late", 90001, "b", "x")]
    left_out = [(None, 5, "no group", "x"), ("hot", None, "no time", "x")]
    schema = "group_id string, sent_at long, row_id string, speaker string"
    df = spark.createDataFrame(rows + left_out, schema).repartition(5)
    marks = {"hot": 200000, "late": 90000}
    kept = spark.createDataFrame(list(marks.items()), "group_id string, sent_at long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        found = ib.chat_segments(df, kept)
        assert found.rdd.getNumPartitions() > 3
        rows_found = found.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {(r.group_id, r.row_id): (r.new_day, r.unread_divider, r.new_bubble, r.bubble) for r in rows_found}
    want = {}
    for group in ("hot", "calm", "late"):
        mine = sorted(((at, row, who) for g, at, row, who in rows if g == group), key=lambda r: r[:2])
        want |= {(group, row): flags for row, flags in straight(mine, marks.get(group)).items()}
    assert got == want
    assert ib.chat_segments(df.limit(0), kept).collect() == []


def test_segments_shuffle_rows_once(spark):
    df = spark.range(1000).selectExpr("cast(id % 3 as string) AS group_id", "id * 60 AS sent_at", "cast(id as string) AS row_id", "'x' AS speaker")
    marks = spark.createDataFrame([("1", 600)], "group_id string, sent_at long")
    plan = ib.chat_segments(df, marks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 3  # windows run over the summary rows only
    assert "RepartitionByExpression" not in plan  # the range shuffle lies before the cut
