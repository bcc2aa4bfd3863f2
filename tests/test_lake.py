"""Partition-scoped maintenance: only touched folders change, only possible folders are read, results equal the whole-table rules."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colloquia.operators import upserts as up
from colloquia.sources.lake import BATCH, BUCKET, DAY, EventLake, KeyedTable, bucket_of

IMAGE = "hash string, file_path string, generator string, parsed_at long, file_missing long, object_path string"
MESSAGE = "group_id string, row_id string, sent_at long, text string, is_media long, input_order long"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_small_delta_rewrites_its_buckets_only(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/images", ("hash",), 16)
    stored = spark.createDataFrame([(f"h{i}", f"p{i}", "webui", 1, i % 2, f"o{i}") for i in range(400)], IMAGE)
    assert len(table.upsert(stored, lambda old, new: old.unionByName(new), stored)) == 16
    before = files(table.path)
    delta = spark.createDataFrame([("h7", "new", "forge", 5, 0, ""), ("h7", "older", "nai", 4, 0, ""), ("fresh", "f", "nai", 5, 0, "")], IMAGE)
    touched = table.upsert(delta, up.upsert_images, stored)
    after, names = files(table.path), {f"{BUCKET}={b}" for b in touched}
    assert len(touched) <= 2 and {k: v for k, v in before.items() if Path(k).parent.name not in names} == {k: v for k, v in after.items() if Path(k).parent.name not in names}
    want = sorted(map(tuple, up.upsert_images(stored, delta).select(stored.columns).collect()))
    assert sorted(map(tuple, table.read(spark, stored).collect())) == want and len(want) == 401
    assert "PartitionFilters: [" + BUCKET in table.part(spark, stored, touched)._jdf.queryExecution().executedPlan().toString().replace("isnotnull", BUCKET)
    table.upsert(delta, up.upsert_images, stored)  # again: the same rows
    assert sorted(map(tuple, table.read(spark, stored).collect())) == want


def test_rules_hold_bucket_by_bucket(spark, tmp_path):
    """Sightings, requests, children and marks: folding deltas one after the other equals the rule on whole tables."""
    sight = "hash string, group_id string, row_id string, sent_at long, speaker string, speaker_uin string, group_name string"
    rows = spark.createDataFrame([(f"h{i % 9}", str(i % 3), str(i % 40), i, f"s{i}", "u", "" if i % 2 else f"n{i}") for i in range(120)], sight).withColumn("seq", F.col("sent_at"))
    table, parts = KeyedTable(f"{tmp_path}/s", ("hash",), 4), [rows.filter(f"seq % 3 = {k}").withColumn("seq", F.lit(1).cast("long") * k * 1000 + F.col("seq")) for k in range(3)]
    like = rows.drop("seq")
    for part in parts:
        table.upsert(part, up.upsert_sightings, like)
    want = up.upsert_sightings(like.limit(0), parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(tuple, table.read(spark, like).collect())) == sorted(map(tuple, want.select(like.columns).collect()))
    loras = spark.createDataFrame([(f"h{i}", f"l{j}") for i in range(30) for j in range(i % 3)], "hash string, lora_name string")
    child = KeyedTable(f"{tmp_path}/l", ("hash",), 8)
    child.upsert(loras, lambda old, new: new)
    gone = spark.createDataFrame([(f"h{i}",) for i in range(30)], "hash string").filter(bucket_of(("hash",), 8).isin(1, 2))
    child.upsert(gone, lambda old, new: up.replace_children(old, new, loras.limit(0)), loras)  # whole buckets become empty
    left = {r[0] for r in child.read(spark, loras).collect()}
    assert left == {r[0] for r in loras.join(gone, "hash", "left_anti").collect()} and left
    marks = KeyedTable(f"{tmp_path}/m", ("group_id",), 4)
    for value in ((5, "b"), (4, "z"), (5, "a")):
        marks.upsert(spark.createDataFrame([("g", *value)], "group_id string, sent_at long, row_id string"), up.advance_marks)
    assert [tuple(r) for r in marks.read(spark, spark.createDataFrame([], "group_id string, sent_at long, row_id string")).collect()] == [("g", 5, "b")]


def messages(spark, days, group="g", start=0, text="t"):
    return spark.createDataFrame([(group, f"{d}-{i}", d * 86400 + i, f"{text}{i}", 0, start + i) for d in days for i in range(20)], MESSAGE)


def test_ingest_opens_the_days_of_the_delta(spark, tmp_path):
    lake = EventLake(f"{tmp_path}/lake", buckets=4)
    for batch, days in enumerate([range(10), range(10, 20), range(20, 30)]):
        lake.append(messages(spark, days), up.ingest_messages, batch)
    delta = messages(spark, [12, 40]).unionByName(messages(spark, [25], "other"))
    bucket = {g: messages(spark, [1], g).select(bucket_of(("group_id",), 4)).first()[0] for g in ("g", "other")}
    places = lake.places(delta, 3)
    assert {(bucket["g"], 12), (bucket["g"], 40), (bucket["other"], 25)} <= set(places) and len(places) <= 6  # sketches may err on the safe side
    opened = lake.read(spark, delta, 3, places)
    assert {(r[0], r[1]) for r in opened.select(BUCKET, DAY).distinct().collect()} <= set(places)
    assert f"cast({BUCKET}" in opened._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    before = files(lake.rows_path)
    lake.append(delta, up.ingest_messages, 3)
    kept = lake.read(spark, delta)
    assert kept.count() == 30 * 20 + 40 and kept.filter(F.col(BATCH) == 3).count() == 40  # day 12 was known
    assert before.items() <= files(lake.rows_path).items()
    lake.append(delta, up.ingest_messages, 3)  # the batch runs again
    assert lake.read(spark, delta).count() == 640


@pytest.mark.parametrize("moved", [1, 9])
def test_a_key_stored_under_another_day_is_found(spark, tmp_path, moved):
    lake = EventLake(f"{tmp_path}/lake", buckets=2)
    lake.append(messages(spark, range(6)), up.ingest_messages, 0)
    again = messages(spark, range(3)).withColumn("sent_at", F.col("sent_at") + moved * 86400).unionByName(messages(spark, [50]))
    lake.append(again, up.ingest_messages, 1)
    assert lake.read(spark, again).filter(F.col(BATCH) == 1).select("row_id").distinct().count() == 20
    assert lake.read(spark, again).count() == 140
