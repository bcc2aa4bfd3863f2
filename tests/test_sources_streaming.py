import json

from pyspark.sql import functions as F

from colloquia.operators import content, intervals, media, upserts
from colloquia.operators.activity import slot_activity
from colloquia.operators.export import csv_records
from colloquia.sources import exports, sinks
from colloquia.streaming import incremental as inc


def document(group, start, covered, rows, pictures=()):
    doc = {"groupIds": [group], "groupNames": {group: f"name {group}"}, "startUnix": start, "endUnix": start + 100,
           "messages": [{"groupId": group, "rowId": r, "sentAt": t, "senderUin": u, "text": x} for r, t, u, x in rows],
           "mediaMessages": [{"groupId": group, "rowId": r, "sentAt": t, "senderUin": "5", "senderName": "Eve", "bodySnippet": "", "mediaRefs": [{"kind": "image", "hash": h, "fileName": "p.png"}]} for r, t, h in pictures],
           "quoteLinks": [{"groupId": group, "rowId": "1", "quotedImageHashes": ["aa"]}]}
    if covered != "absent":
        doc["coveredFromUnix"] = covered
    return doc


def write_docs(folder, docs, prefix="e"):
    folder.mkdir(exist_ok=True)
    for i, d in enumerate(docs):
        (folder / f"{prefix}{i}.json").write_text(d if isinstance(d, str) else json.dumps(d), encoding="utf-8")


def test_read_exports_and_ingest_rules(spark, tmp_path):
    write_docs(tmp_path / "x", [document("1", 100, "absent", [("1", 101, "7", "  hi  there "), ("2", 102, "8", "\x07")], [("3", 103, "h" * 32)]), document("1", 200, None, [("1", 101, "7", "again")]), document("2", 300, 350, []), "{oops"])
    tables = exports.read_exports(spark, str(tmp_path / "x"))
    delta = tables["text"].unionByName(tables["media"])
    fresh = upserts.ingest_messages(delta.limit(0), delta).collect()
    assert sorted((r.group_id, r.row_id, r.text, r.speaker, r.media_kinds) for r in fresh if r.row_id != "1") == [("1", "m3", "p.png", "Eve", "image")]
    assert len([r for r in fresh if r.row_id == "1"]) == 1 and len(fresh) == 2
    assert sorted((r.group_id, r.start_unix, r.end_unix) for r in upserts.append_coverage(tables["scans"]).collect()) == [("1", 100, 200), ("2", 350, 400)]
    assert tables["quotes"].first().quoted_hashes == ["aa"] and tables["refs"].first().hash == "h" * 32


def test_manifests_survive_a_corrupt_file(spark, tmp_path):
    for run, body in (("run-1", json.dumps([{"rowId": "1", "groupId": "1", "hash": "a" * 32, "kind": "image", "copiedPath": "x/a.png"}, {"rowId": "2", "groupId": "1", "kind": "file", "copiedPath": "x/B.TXT"}])), ("run-2", '[{"rowId": "1"')):
        (tmp_path / run / "media").mkdir(parents=True)
        (tmp_path / run / "media" / "media-manifest.json").write_text(body)
    rows = exports.read_manifests(spark, f"{tmp_path}/*/media/media-manifest.json").filter("rowId is not null and hash is not null or copiedPath is not null")
    assert {(r.run_id, r.rowId) for r in rows.collect()} == {("run-1", "1"), ("run-1", "2")}
    sizes = spark.createDataFrame([("x/a.png", 5), ("x/B.TXT", 6)], "copied_path string, bytes long")
    assert {(r.content_key, r.content_key_source, r.bytes) for r in exports.media_index_rows(rows, sizes).collect()} == {("a" * 32, "hash", 5), ("b.txt", "filename", 6)}


def test_group_list_and_files(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("1001\tone\nabc\ttwo\n 1002 \t\n")
    assert sorted(tuple(r) for r in exports.read_group_list(spark, str(tmp_path / "g.tsv")).collect()) == [("1001", "one"), ("1002", "")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"hello")
    row = exports.read_file_digests(spark, str(tmp_path / "f")).first()
    assert (row.size, row.md5) == (5, "5d41402abc4b2a76b9719d911017c592")
    assert exports.read_file_sizes(spark, str(tmp_path / "f")).first().size == 5


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("2024-01-01", 2, "b", "second"), ("2024-01-01", 1, "a", "first"), ("2024-01-02", 3, "c", "third")], "day string, sent_at long, row_id string, line string")
    sinks.write_transcripts(lines, f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t/day=2024-01-01").coalesce(1).collect()] == ["first", "second"]
    sinks.write_report({"lines": lines}, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/lines").count() == 3
    record = [("h", "=x", "", "g", "none", "c", ["a", "b"], 1, 2, "-s", 'q"n', 3, "p", "")]
    df = spark.createDataFrame(record, "hash string, imageFile string, promptFile string, generator string, promptSource string, checkpoint string, loras array<string>, width long, height long, sender string, groupName string, sentAt long, prompt string, negativePrompt string")
    sinks.write_csv(csv_records(df), f"{tmp_path}/c")
    text = [r.value for r in spark.read.text(f"{tmp_path}/c").collect()]
    assert text[1] == '"h","\'=x","","g","none","c","a | b","1","2","\'-s","q""n","3","p",""'
    sinks.write_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().loras == ["a", "b"]
    sinks.write_report({"lines": lines}, f"{tmp_path}/by", {"lines": ["day"]})
    assert spark.read.parquet(f"{tmp_path}/by/lines").filter("day = '2024-01-01'").count() == 2 and (tmp_path / "by" / "lines" / "day=2024-01-02").is_dir()
    sinks.write_lines(lines, ["sent_at"], f"{tmp_path}/l")
    assert spark.read.text(f"{tmp_path}/l").count() == 3


MSG = "group_id string, row_id string, sent_at long, speaker string, is_media long, input_order long"


def stream_of(spark, tmp_path, df, name, parts=1):
    df.repartition(parts).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")


def sink_rows(stream, tmp_path, name, mode="append"):
    rows = []
    query = inc.to_batches(stream, lambda b, i: rows.extend(b.collect()), f"{tmp_path}/cp-{name}", mode)
    query.awaitTermination()
    return rows


def test_ingest_stream_equals_batch_and_repeats_are_harmless(spark, tmp_path):
    docs = [document("1", 100, "absent", [(str(i), 100 + i, "7", f"text {i}") for i in range(5)]), document("1", 150, "absent", [("4", 104, "7", "text 4"), ("9", 160, "8", "new")])]
    write_docs(tmp_path / "in", docs[:1])
    for step in (1, 2):
        query = inc.ingest_stream(inc.stream_exports(spark, str(tmp_path / "in")), f"{tmp_path}/lake", f"{tmp_path}/cp")
        query.awaitTermination()
        write_docs(tmp_path / "in", docs[1:], "later")
        del step
    got = spark.read.parquet(inc.message_lake(f"{tmp_path}/lake").rows_path)
    assert [tuple(r) for r in inc.name_table(f"{tmp_path}/lake").read(spark, spark.createDataFrame([], "group_id string, name string")).collect()] == [("1", "name 1")]
    assert got.count() == 6 and got.select("row_id").distinct().count() == 6
    assert {(r.start_unix, r.end_unix) for r in intervals.merge_intervals(spark.read.parquet(f"{tmp_path}/lake/scan_ranges")).collect()} == {(100, 250)}


def test_slots_blocks_and_repeats_as_streams(spark, tmp_path):
    rows = [("g", str(i), 1000 + i * 400 + (4000 if i > 6 else 0), "ab"[i % 2], i % 3 % 2, i) for i in range(14)] + [("zz", "close", 10 ** 7, "z", 0, 99)]
    df = spark.createDataFrame(rows, MSG)
    want = {tuple(r) for r in slot_activity(df.filter("group_id='g'"), 0, 10 ** 6, 3600).select("group_id", "slot_index", "message_count", "media_count", "speaker_count", "first_unix", "last_unix").collect()}
    first = sink_rows(inc.slot_activity_stream(stream_of(spark, tmp_path, df, "a"), 3600), tmp_path, "a")
    partial = spark.createDataFrame([(r.group_id, r.w.start, r.speaker, r.message_count, r.media_count, r.first_unix, r.last_unix) for r in first], "group_id string, s timestamp, speaker string, message_count long, media_count long, first_unix long, last_unix long").withColumn("w", F.struct(F.col("s").alias("start")))
    assert {tuple(r) for r in inc.speakers_of(partial, 0, 3600).select("group_id", "slot_index", "message_count", "media_count", "speaker_count", "first_unix", "last_unix").collect()} == want
    blocks = {tuple(r) for r in content.time_blocks(df.filter("group_id='g'")).select("group_id", "start_unix", "end_unix", "message_count").collect()}
    assert {tuple(r) for r in sink_rows(inc.session_blocks(stream_of(spark, tmp_path, df, "b"), 1800), tmp_path, "b")} == blocks
    doubled = df.unionByName(df)
    assert len(sink_rows(inc.first_of_each(stream_of(spark, tmp_path, doubled, "c")).select("group_id", "row_id"), tmp_path, "c")) == len(rows)


def test_marks_answers_and_coverage_as_streams(spark, tmp_path):
    marks = spark.createDataFrame([("g", 5, "a"), ("g", 7, "b"), ("h", 1, "c")], "group_id string, sent_at long, row_id string")
    assert {tuple(r) for r in sink_rows(inc.latest_marks(stream_of(spark, tmp_path, marks, "m")), tmp_path, "m", "update")} == {("g", 7, "b"), ("h", 1, "c")}
    spans = spark.createDataFrame([("g", 10, 50), ("g", 50, 70), ("g", 86000, 90000), ("h", 5, 6)], "group_id string, start_unix long, end_unix long")
    assert {tuple(r) for r in sink_rows(inc.latest_coverage(stream_of(spark, tmp_path, spans, "e")), tmp_path, "e", "update")} == {("g", 90000), ("h", 6)}
    asks = spark.createDataFrame([("g", "1", 1000, "u1"), ("g", "2", 5000, "u1")], "group_id string, row_id string, sent_at long, sender string")
    text = "masterpiece, best quality, 1girl, solo, x"
    says = spark.createDataFrame([("g", 1000, "u1", 1, text), ("g", 1500, "u2", 2, text), ("g", 1400, "u3", 3, "chat"), ("g", 1600, "u3", 4, text), ("g", 6801, "u2", 5, text)], "group_id string, sent_at long, sender string, input_order long, text string")
    pairs = sink_rows(inc.answer_pairs(stream_of(spark, tmp_path, asks, "q"), stream_of(spark, tmp_path, says, "s")), tmp_path, "p")
    first = inc.earliest_answers(spark.createDataFrame([(r.group_id, r.ask_row_id, r.ask_at, r.answer_at, r.answer_sender, r.answer_order, r.text) for r in pairs], "group_id string, ask_row_id string, ask_at long, answer_at long, answer_sender string, answer_order long, text string"))
    assert [(r.ask_row_id, r.answer_at, r.answer_sender) for r in first.collect()] == [("1", 1500, "u2")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", inc.STATE_STORE)
    try:
        got = sink_rows(inc.merged_coverage_stream(stream_of(spark, tmp_path, spans, "v")), tmp_path, "v", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    whole = intervals.merge_intervals(spark.createDataFrame([(r.group_id, r.start_unix, r.end_unix) for r in got], spans.schema))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in intervals.merge_intervals(spans).collect()}


def test_media_rules(spark):
    refs = spark.createDataFrame([("g", "10", 10, 5, "image", "x", 1), ("g", "9", 9, 5, "image", "x", 2), ("g", "11", 11, 6, "emoji", "x", 3), ("g", "12", 12, 7, "image", None, 4), ("h", "1", 1, 9, "image", "x", 5)],
                                 "group_id string, row_id string, row_num long, sent_at long, kind string, hash string, input_order long")
    flagged = media.owned_refs(refs)
    assert {r.row_id: r.owned for r in flagged.collect()} == {"10": False, "9": True, "11": True, "12": True, "1": True}
    assert [(r.row_id, r.quoted_hash) for r in media.quote_links(flagged).collect()] == [("10", "x")]


def test_a_late_earlier_answer_replaces_the_stored_one(spark):
    from colloquia.streaming.incremental import merge_answers
    schema = "group_id string, ask_row_id string, ask_at long, answer_at long, answer_order long, answer_sender string, text string"
    first = merge_answers(spark.createDataFrame([], schema), spark.createDataFrame([("g", "1", 10, 40, 4, "b", "later"), ("g", "1", 10, 45, 5, "c", "last"), ("g", "2", 12, 30, 3, "d", "own")], schema))
    late = spark.createDataFrame([("g", "1", 10, 20, 2, "e", "early")], schema)
    second = merge_answers(first, late)
    assert sorted((r.ask_row_id, r.answer_at, r.text) for r in second.collect()) == [("1", 20, "early"), ("2", 30, "own")]
    assert sorted(map(tuple, merge_answers(second, late).collect())) == sorted(map(tuple, second.collect()))


def test_sidecars_have_the_asked_names(spark, tmp_path):
    rows = [(f"{'ab'[i % 2]}/stem {i}_2.txt", f"prompt {i} é") for i in range(40)] + [("top.txt", None)]
    files = spark.createDataFrame(rows, "path string, content string").repartition(5)
    for _ in range(2):  # a second export writes the same files again
        sinks.write_sidecars(files, f"{tmp_path}/s")
        assert {(str(p.relative_to(tmp_path / "s")), p.read_text()) for p in (tmp_path / "s").rglob("*") if p.is_file()} == {(n, c or "") for n, c in rows}
        assert not list((tmp_path / "s").glob("_staging*"))


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    import pytest
    good = spark.createDataFrame([(f"x{i}.txt", "c") for i in range(20)], "path string, content string").repartition(2)
    with pytest.raises(Exception, match="not a file below"):
        sinks.write_sidecars(good.unionByName(spark.createDataFrame([("../out.txt", "c")], "path string, content string")), f"{tmp_path}/s")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
