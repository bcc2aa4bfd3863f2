"""Plans that keep their cost when the tables grow."""

import json

from colloquia.functions import params as pm
from colloquia.operators import graph as gr
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_small_file_are_not_broadcast_before_they_are_measured(spark):
    rows = spark.range(100000)  # 800 kB by estimate
    wide = rows.select("id", F.repeat(F.col("id").cast("string"), 100).alias("text"))
    assert "BroadcastHashJoin" not in plan(rows.join(wide, "id"))


def test_graph_steps_read_the_graphs_once(spark, tmp_path):
    graph = {"1": {"class_type": "KSampler", "inputs": {"positive": ["2", 0], "negative": ["2", 0], "steps": 3}}, "2": {"class_type": "Text", "inputs": {"text": "a"}}}
    spark.createDataFrame([("h", json.dumps(graph))], "hash string, graph string").write.parquet(str(tmp_path / "g"))
    inputs = gr.graph_inputs(spark.read.parquet(str(tmp_path / "g")))
    sampler = gr.pick_sampler(inputs)
    assert [tuple(r) for r in sampler.collect()] == [("h", "1", "a", "a")]
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert [scans(df) for df in (sampler, gr.graph_assets(inputs), gr.graph_params(inputs, sampler))] == [1, 1, 2]


def test_fields_are_read_once_however_many_there_are(spark):
    line = ", ".join(f"K{i}: {i}" for i in range(1500)) + ", Steps: 3, Steps: 4"
    df = spark.createDataFrame([(line,)] * 4, "t string").select(pm.parse_param_fields(F.col("t")).alias("f"))
    got = df.first().f
    assert got.params == {"steps": "4"} and len(got.extra) == 1500 and got.extra["K1499"] == "1499"
    text = df._jdf.queryExecution().analyzed().toString()
    assert text.count("lower(") < 12  # the key of a field is judged once a list, not once a key


def test_tokens_of_a_text_are_computed_before_it_meets_its_messages(spark):
    from colloquia.functions.text import token_counts
    from colloquia.operators.content import token_stats
    from colloquia.plans import views

    counts = spark.createDataFrame([("bb aaa bbb aaa AAA",), ("",)], "t string").select(token_counts("t").alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in counts] == [[("aaa", 3), ("bbb", 1)], []]
    optimized = token_stats(views.tokened(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    above, below = optimized.split("+- Join", 1)
    computing = [line for line in below.splitlines() if "regexp_extract_all" in line]
    assert "regexp_extract_all" not in above and len(computing) == 1


def test_every_good_label_is_trusted(spark):
    from colloquia.llm.quality import trusted_ids

    assert trusted_ids(spark.range(60000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")).count() == 30000


def test_trusted_documents_are_marked_without_a_shuffle_of_texts(spark, monkeypatch):
    from colloquia.llm import quality

    ids = [*range(-130, 130), 2 ** 31 + 5, -(2 ** 40), 2 ** 62, None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n % 3 == 0)) for n, i in enumerate(ids)] + [(7, 1), (7, 0)], "doc_id long, quality int")
    want = {(i, f"t{i}", int(n % 3 == 0 and i is not None and i != 7)) for n, i in enumerate(ids)}
    found = quality.marked(docs, labels)
    assert {tuple(r) for r in found.collect()} == want and "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found)
    names = quality.marked(docs.withColumn("doc_id", docs.doc_id.cast("string")), labels.withColumn("doc_id", labels.doc_id.cast("string")))
    assert sum(r.target for r in names.collect()) == sum(t for _, _, t in want)
    monkeypatch.setattr(quality, "MASK_ROWS", 0)
    assert {tuple(r) for r in quality.marked(docs, labels).collect()} == want


def test_only_messages_that_may_ask_meet_the_quotes(spark):
    from colloquia.operators.pairing import find_asks

    said = [("g", str(i), 1, "s", "S", i, t) for i, t in enumerate(["kkt", "发我原图", "发我原图", "x" * 5000, None])]
    messages = spark.createDataFrame(said, "group_id string, row_id string, sent_at long, sender string, speaker string, input_order long, text string")
    quotes = spark.createDataFrame([("g", "1", ["h"]), ("g", "3", ["h"])], "group_id string, row_id string, quoted_hashes array<string>")
    found = find_asks(messages, quotes)
    assert [(r.row_id, r.rule, r.quoted_hash) for r in found.orderBy("row_id").collect()] == [("0", "kk:t", None), ("1", "contextual", "h")]
    left = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)[1]
    assert "Filter isnotnull(_beside" in left


def test_references_without_a_path_are_spread_over_the_tasks(spark):
    from pyspark.sql import functions as F

    from colloquia.operators.media import resolve_sources

    refs = spark.range(4000).selectExpr("cast(id as string) as row_id", "case when id = 7 then 'a/x.png' end as local_path", "cast(null as string) as hash", "cast(null as string) as file_name")
    files = spark.createDataFrame([("a/x.png", 1), (None, 2)], "path string, size long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, value in zip(before, ("false", "-1")):
            spark.conf.set(k, value)
        found = resolve_sources(refs, files, ["png"])
        rows = found.select("row_id", "source_path", "via", F.spark_partition_id().alias("part")).collect()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert [(r.row_id, r.source_path, r.via) for r in rows if r.via != "none"] == [("7", "a/x.png", "path")] and len(rows) == 4000
    assert max(sum(r.part == p for r in rows) for p in range(4)) < 1500


def test_nodes_are_told_apart_without_a_shuffle(spark):
    odd = '{"2":{"class_type":"A","inputs":{"x":1,"y":["1",0]}},"x":{"inputs":{"t":"a"}},"1":{"class_type":"B","inputs":{}},"7":{"class_type":"C"},"8":[1],"9":{"inputs":"no"},"2":{"class_type":"A","inputs":{"z":2}}}'
    graphs = spark.createDataFrame([("g", odd), ("h", '{"3":{"class_type":"KSampler","inputs":{"seed":NaN}}}'), ("i", "no"), ("j", None)], "hash string, graph string")
    nodes, columns = gr.graph_tables(graphs)[0], ["hash", "node_id", "node_ord", "class_type"]
    wanted = gr.graph_inputs(graphs).select(*columns).distinct()
    assert sorted(map(tuple, nodes.select(*columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert {tuple(r) for r in nodes.collect()} >= {("h", "3", 3, "KSampler")} and "Exchange" not in plan(nodes)
