import random

from pyspark.sql import functions as F

from colloquia.operators.ordered import first_after, ordinal, points_in_windows, recent_before, split_window, time_bucket, top_per_key


def test_split_window_equals_plain_scan(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice("ab"), rng.randrange(0, 500)) for _ in range(200)})
    data = [(k, t, rng.randrange(100)) for k, t in rows]
    df = spark.createDataFrame(data, "k string, t long, v long").withColumn("b", time_bucket("t", 37))
    got = {(r.k, r.t): r for r in split_window(df, ["k"], "b", ["t"], p=("prev", F.col("v")), n=("next", F.col("v")), mb=("max_before", F.col("v")),
                                                mt=("max_through", F.col("v")), s=("sum_through", F.col("v")), km=("key_max", F.col("v"))).collect()}
    for key in "ab":
        mine = [(t, v) for k, t, v in data if k == key]
        for i, (t, v) in enumerate(mine):
            r = got[(key, t)]
            before = [x for _, x in mine[:i]]
            assert r.p == (before[-1] if before else None)
            assert r.n == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert r.mb == (max(before) if before else None)
            assert r.mt == max([*before, v])
            assert r.s == sum(before) + v
            assert r.km == max(x for _, x in mine)


def test_ordinal_counts_per_key_even_when_one_key_dominates(spark):
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    random.Random(2).shuffle(rows)
    got = ordinal(spark.createDataFrame(rows, "k string, t long"), ["k"], ["t"]).collect()
    assert len(got) == 305 and all(r.ordinal == r.t + 1 for r in got)


def test_top_per_key_above_the_partial_limit(spark):
    rows = [("a", i) for i in range(3000)]
    got = top_per_key(spark.createDataFrame(rows, "k string, t long"), ["k"], [F.col("t").desc()], 1500).collect()
    assert sorted(r.t for r in got) == list(range(1500, 3000)) and all(r.rank == 3000 - r.t for r in got)



def test_first_after_equals_brute_force(spark):
    rng = random.Random(3)
    candidates = [(rng.choice("xy"), rng.randrange(0, 400), i, rng.choice(["", "1", "2", "3"]), f"p{i}") for i in range(160)]
    probes = [(rng.choice("xy"), rng.randrange(0, 400), rng.choice(["", "1", "2"])) for _ in range(120)]
    got = first_after(spark.createDataFrame(probes, "group_id string, sent_at long, sender string"),
                      spark.createDataFrame(candidates, "group_id string, sent_at long, ord long, sender string, payload string"), 30).collect()
    assert len(got) == len(set(probes))
    for r in got:
        fits = sorted([c for c in candidates if c[0] == r.group_id and r.sent_at <= c[1] <= r.sent_at + 30 and (r.sender == "" or c[3] != r.sender)], key=lambda c: (c[1], c[2]))
        assert (r.payload, r.answer_at) == ((fits[0][4], fits[0][1]) if fits else (None, None))


def test_recent_before_equals_brute_force(spark):
    rng = random.Random(4)
    facts = [(rng.choice("xy"), rng.randrange(0, 300), i, f"p{i}") for i in range(120)]
    probes = [(rng.choice("xy"), rng.randrange(0, 320)) for _ in range(80)]
    got = recent_before(spark.createDataFrame(probes, "group_id string, sent_at long"), spark.createDataFrame(facts, "group_id string, sent_at long, ord long, payload string"), ["group_id"], 25).collect()
    assert len(got) == len(set(probes))
    for r in got:
        fits = [f for f in facts if f[0] == r.group_id and r.sent_at - 25 <= f[1] <= r.sent_at]
        best = max(fits, key=lambda f: (f[1], -f[2]))[3] if fits else None
        assert (r.n_before or 0, r.latest) == (len(fits), best)


def test_points_in_windows(spark):
    points = spark.createDataFrame([("g", t) for t in range(0, 100, 3)], "group_id string, t long")
    windows = spark.createDataFrame([("g", 5, 31), ("g", 90, 90), ("h", 0, 100)], "group_id string, a long, b long")
    got = sorted(r.t for r in points_in_windows(points, windows, ["group_id"], "t", "a", "b", 10).collect())
    assert got == [t for t in range(0, 100, 3) if 5 <= t < 31]
