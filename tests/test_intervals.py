import hashlib
import random


from pyspark.sql import functions as F

from colloquia.operators import activity as act
from colloquia.operators import inbox as ib
from colloquia.operators import intervals as iv

RANGE = "group_id string, start_unix long, end_unix long"


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def sample(seed, n=150, span=400000):
    rng = random.Random(seed)
    return [(rng.choice(["1", "2", "3"]), a, a + rng.randrange(1, 9000)) for a in (rng.randrange(1, span) for _ in range(n))]


def test_merge_and_gaps_equal_brute_force(spark):
    for seed in (5, 6):
        rows = sample(seed)
        df = spark.createDataFrame(rows, RANGE)
        got = iv.merge_intervals(df).collect()
        for g in "123":
            want = merged([(a, b) for k, a, b in rows if k == g])
            assert sorted((r.start_unix, r.end_unix) for r in got if r.group_id == g) == want
        groups = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "group_id string")
        gaps = iv.gaps(df, groups, 50000, 300000).collect()
        for g in "1234":
            covered = merged([(max(50000, a), min(300000, b)) for k, a, b in rows if k == g and b > 50000 and a < 300000])
            edges = [50000] + [x for pair in covered for x in pair] + [300000]
            want = [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2) if edges[i] < edges[i + 1]]
            assert sorted((r.start_unix, r.end_unix) for r in gaps if r.group_id == g) == want


def test_touching_ranges_merge(spark):
    df = spark.createDataFrame([("1", 10, 20), ("1", 20, 30), ("1", 31, 40)], RANGE)
    assert sorted((r.start_unix, r.end_unix) for r in iv.merge_intervals(df).collect()) == [(10, 30), (31, 40)]


def test_timeline_slots(spark):
    ranges = spark.createDataFrame([("1", 1000, 1300), ("1", 1200, 1500), ("2", 1000, 3000)], RANGE)
    msgs = spark.createDataFrame([("1", "a", 1100, "ann", 0), ("1", "b", 1200, "bob", 0), ("1", "c", 1300, "ann", 1)], "group_id string, row_id string, sent_at long, speaker string, is_media long")
    groups = spark.createDataFrame([("1",), ("2",), ("3",)], "group_id string")
    names = spark.createDataFrame([("1", "one")], "group_id string, name string")
    rows = {(r.group_id, r.slot_index): r for r in act.coverage_timeline(msgs, ranges, groups, names, 1000, 3000, 1000).collect()}
    assert len(rows) == 6
    first = rows[("1", 0)]
    assert (first.covered_seconds, first.coverage_ratio, first.message_count, first.text_count, first.media_count, first.speaker_count) == (500, 0.5, 3, 2, 1, 2)
    assert (first.top_speakers, first.busiest_hour_unix, first.busiest_hour_count) == ("ann:2,bob:1", 1000, 3)
    assert rows[("2", 1)].coverage_ratio == 1 and rows[("2", 1)].message_count == 0 and rows[("3", 0)].coverage_ratio == 0
    health = act.coverage_health(ranges, groups, 1000, 3000).first()
    assert (health.total_seconds, health.covered_seconds, health.affected_group_count, health.earliest_gap_unix) == (6000, 2500, 2, 1000)


def test_equal_gaps_make_one_batch_and_plan_splits(spark):
    gaps = spark.createDataFrame([("2", 100, 400), ("1", 100, 400), ("1", 350, 600)], RANGE)
    batches = iv.rescan_batches(gaps)
    found = batches.collect()
    assert sorted((r.start_unix, r.end_unix, r.group_id) for r in found) == [(100, 400, "1"), (100, 400, "2"), (350, 600, "1")]
    assert len({r.batch_key for r in found}) == 2
    tasks = iv.backfill_plan(batches, 100).collect()
    assert sorted((r.group_id, r.start_unix, r.end_unix) for r in tasks) == [("1", a, a + 100) for a in range(100, 600, 100)] + [("2", a, a + 100) for a in range(100, 400, 100)]
    one = next(r for r in tasks if r.group_id == "2" and r.start_unix == 100)
    assert one.task_id == hashlib.sha256(b"2:100:200").hexdigest()[:20]
    assert iv.check_plan(iv.backfill_plan(batches, 100), 100).count() == 0
    assert iv.plan_totals(iv.backfill_plan(batches, 100), batches).first().total_group_seconds == 800


def test_bad_batches_are_named(spark):
    rows = spark.createDataFrame([(["1"], 5, 5), ([], 1, 2), (["x"], 1, 2), (["7"], 1, 2)], "group_ids array<string>, start_unix long, end_unix long")
    assert sorted(r.reason for r in iv.invalid_batches(rows).collect()) == ["invalid-range", "no-groups", "non-numeric-group"]


def test_touching_batches_of_the_same_groups_join(spark):
    rows = spark.createDataFrame([(["1", "2"], 0, 10), (["2", "1"], 10, 20), (["3"], 0, 20)], "group_ids array<string>, start_unix long, end_unix long")
    assert sorted((r.group_id, r.start_unix, r.end_unix) for r in iv.merge_batches(iv.batch_rows(rows)).collect()) == [("1", 0, 20), ("2", 0, 20), ("3", 0, 20)]


def test_more_groups_than_any_former_batch_size_stay_one_batch(spark):
    """150 adjacent ranges missed by 1,200 groups fold into one batch of 1,200 rows."""
    rows = spark.range(1200).select(F.col("id").cast("string").alias("group_id"), F.explode(F.sequence(F.lit(0), F.lit(149))).alias("i")).select(
        (F.col("i") * 10 + 100).cast("long").alias("start_unix"), (F.col("i") * 10 + 110).cast("long").alias("end_unix"), "group_id")
    merged = iv.merge_batches(iv.rescan_batches(rows))
    assert merged.select("start_unix", "end_unix", "batch_key").distinct().collect() == [(100, 1600, merged.first().batch_key)]
    assert merged.count() == 1200


def test_headers_are_checked(spark):
    tasks = iv.backfill_plan(iv.rescan_batches(spark.createDataFrame([("1", 100, 400), ("1", 100, 400), ("2", 100, 300)], RANGE)), 100)
    header = iv.plan_totals(tasks, tasks.withColumn("batch_key", F.lit("x")))
    assert iv.check_header(header, tasks).collect() == []
    wrong = header.withColumn("total_group_seconds", F.lit(1).cast("long")).withColumn("source_batch_count", F.lit(0).cast("long"))
    assert sorted(r.violation for r in iv.check_header(wrong, tasks).collect()) == ["source_batch_count", "total_group_seconds"]
    twice = iv.plan_totals(tasks.union(tasks), tasks.withColumn("batch_key", F.lit("x")))
    assert "plan_id" in [r.violation for r in iv.check_header(twice, tasks).collect()]
    assert "empty" in [r.violation for r in iv.check_header(header, tasks.limit(0)).collect()]


def test_backfill_state_keeps_failures_until_success(spark):
    state = spark.createDataFrame([("a", "done", ""), ("b", "failed", "old")], "task_id string, status string, message string")
    tries = spark.createDataFrame([("a", 1, "failed", "late"), ("b", 1, "failed", "new"), ("c", 1, "failed", "x"), ("c", 2, "done", "")], "task_id string, attempt long, status string, message string")
    assert sorted(tuple(r) for r in iv.advance_state(state, tries).collect()) == [("a", "done", ""), ("b", "failed", "new"), ("c", "done", "")]


def test_coverage_points_are_closed_at_both_ends(spark):
    points = spark.createDataFrame([(0,), (9,), (10,), (20,), (21,)], "file_mtime long")
    ranges = spark.createDataFrame([("1", 10, 15), ("2", 12, 20)], RANGE)
    assert {r.file_mtime for r in iv.inside_coverage(points, ranges).filter("inside").collect()} == {10, 20}


def test_resume_point_rules(spark):
    targets = spark.createDataFrame([("1",), ("2",)], "group_id string")
    now = 100 * 86400
    ranges = spark.createDataFrame([("1", now - 5000, now - 4000), ("2", now - 9000, now - 3000)], RANGE)
    assert ib.resume_point(ranges, targets, now).first().start_unix == now - 4600
    old = spark.createDataFrame([("1", 5, 10)], RANGE)
    assert ib.resume_point(old, targets, now).first().start_unix == now - 30 * 86400 - 600
    assert ib.resume_point(ranges.limit(0), targets, now).first().start_unix == now - 26 * 3600


def test_windows_and_paging(spark):
    assert iv.historical_window(7, 1_000_000) == (1_000_000 - 604800, 1_000_000)
    start, _ = iv.current_window(1, 1704067200)
    assert (start + 8 * 3600) % 86400 == 0
    rows = spark.createDataFrame([(f"{i}", 100 + i // 2) for i in range(10)], "row_id string, sent_at long")
    page = ib.page(rows, 3, after=(101, "2")).collect()
    assert [r.row_id for r in page] == ["3", "4", "5"] and all(r.has_more for r in page)
    back = ib.page(rows, 4, before=(101, "3")).collect()
    assert [r.row_id for r in back] == ["0", "1", "2"] and not any(r.has_more for r in back)
    assert ib.clamp_page(501) == 300 and ib.clamp_page(500) == 500


def test_row_ids_compare_as_text_for_unread(spark):
    msgs = spark.createDataFrame([("1", "10", 5), ("1", "9", 5), ("1", "1", 6)], "group_id string, row_id string, sent_at long")
    marks = spark.createDataFrame([("1", 5, "10")], "group_id string, sent_at long, row_id string")
    assert ib.unread(msgs, marks).first().unread_count == 2
