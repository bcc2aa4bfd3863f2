"""Documents read in byte-range splits give the tables of whole documents, wherever the splits fall."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquia.sources import exports

ODD = ['plain', '}{"][', 'a "quoted" \\ back\\\\slash', '"messages":[{"x":1}]', '日本 😀\n\t', '', '{"groupId"', '\\"', '}},{', ']', '\\u0022']


def document(n, rng, extra=""):
    words = lambda: rng.choice(ODD) + str(rng.randrange(99))
    doc = {"groupIds": ["1", "2"], "errors": [{"where": words()} for _ in range(rng.randrange(3))], "startUnix": 100, "groupNames": {"1": "na}me", "2": words()},
           "messages": [{"groupId": "1", "rowId": str(i), "sentAt": 100 + i, "senderUin": "7", "text": words()} for i in range(n)],
           "mediaMessages": [{"groupId": "2", "rowId": str(i), "sentAt": i, "mediaRefs": [{"kind": "image", "hash": words(), "fileName": words()} for _ in range(i % 3)], "bodySnippet": words()} for i in range(n // 2)],
           "quoteLinks": [{"groupId": "1", "rowId": str(i), "quotedImageHashes": [words(), "b"]} for i in range(n % 4)], "other": [{"messages": [{"rowId": words()}], "deep": {"a": [{}]}}], "endUnix": 900}
    if extra == "covered":
        doc["coveredFromUnix"] = None
    return doc


def rows(tables):
    return {k: sorted(map(str, map(tuple, t.drop("input_order").collect()))) for k, t in tables.items()}


@pytest.mark.parametrize("block", [97, 1000])
def test_splits_equal_whole_documents(spark, tmp_path, block):
    rng = random.Random(block)
    docs = [json.dumps(document(5, rng)), json.dumps(document(9, rng, "covered"), ensure_ascii=False) + "\n", json.dumps(document(0, rng), indent=2), json.dumps(document(3, rng))[:-9], "{oops", json.dumps({"messages": []}), json.dumps(document(4, rng), separators=(", ", " : "))]
    (tmp_path / "x").mkdir()
    for i, d in enumerate(docs):
        (tmp_path / "x" / f"{i}.json").write_text(d, encoding="utf-8")
    want = rows(exports.read_exports(spark, str(tmp_path / "x")))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = exports.read_exports(spark, str(tmp_path / "x"), whole=0)
        found = rows(got)
        order = [r[0] for r in got["text"].filter(F.col("file").endswith("1.json")).orderBy("input_order").select("row_id").collect()]
        both = rows(exports.read_exports(spark, str(tmp_path / "x"), whole=len(docs[0].encode())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: len(v) for k, v in want.items()} == {k: len(v) for k, v in found.items()} and found == want == both
    assert len(want["text"]) == 5 + 9 + 4 and order == [str(i) for i in range(9)]


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.json", "w") as out:
        out.write('{"groupIds":["1"],"startUnix":1,"endUnix":2,"messages":[')
        out.write(",".join(json.dumps({"groupId": "1", "rowId": str(i), "sentAt": i, "senderUin": "7", "text": f"text {i} }}{{"}) for i in range(100_000)))
        out.write("]}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert spark.read.option("lineSep", "}").text(f"{tmp_path}/big.json").rdd.getNumPartitions() >= 4
        text = exports.read_exports(spark, f"{tmp_path}/big.json", whole=1 << 20)["text"]
        assert tuple(text.agg(F.count("*"), F.count_distinct("row_id"), F.max("input_order"), F.sum(F.col("row_id").cast("long") - F.col("input_order"))).first()) == (100_000, 100_000, 99_999, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
