"""Queries over generation metadata, workflow graphs, runs and digests."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from colloquia.functions import params as pm
from colloquia.functions import values as val
from colloquia.operators import chunks as ch
from colloquia.operators import content as ct
from colloquia.operators import digest as dg
from colloquia.operators import graph as gr
from colloquia.operators import harvest as hv
from colloquia.operators import runs as rn
from colloquia.operators import upserts as up
from colloquia.plans import views as v
from colloquia.plans.catalog_queries import request_rows
from colloquia.plans.content_queries import named_topics, partial_answers
from colloquia.plans.media_queries import FILES, files
from colloquia.plans.registry import ORACLES, query
from colloquia.plans.views import START, duck
from colloquia.session import shared_folder
from colloquia.sources import exports as src


def key():
    return F.col("p_partkey")



def _text(c):
    return c.cast("string")


# ---- metadata ----
def block_text():
    return F.concat(F.col("p_name"), F.lit(", <lora:Style"), _text(key() % 5), F.lit(":0.8>, <lora:none:1>\nNegative prompt: low quality,\nblurry\nSteps: "), _text(F.col("p_size")), F.lit(", Sampler: Euler a, CFG scale: "),
                     _text(1 + key() % 9), F.lit(".5, Seed: "), _text(key()), F.lit(', Model: '), F.col("p_brand"), F.lit(', Lora hashes: "Style'), _text(key() % 5), F.lit(": ab, Other"), _text(key() % 3),
                     F.lit(': cd", Mood: calm, Version: '), F.when(key() % 2 == 0, "f2.0").otherwise("v1.9"))


def blocks(s, d):
    """A parameter block per part, with quoted style hashes and an unknown field."""
    return v.texts(s, d, "part", "p_partkey").select(F.md5(_text(key())).alias("hash"), "p_partkey", block_text().alias("block"))


@query("parse_params_block", duck("", """SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, p_name || ', <lora:Style' || p_partkey%5 || ':0.8>, <lora:none:1>' AS prompt, 'low quality,' || chr(10) || 'blurry' AS negative_prompt, p_brand AS checkpoint,
  CASE WHEN p_partkey%2=0 THEN 'forge' ELSE 'webui' END AS generator, CAST(p_size AS VARCHAR) AS steps, CAST(1+p_partkey%9 AS VARCHAR) || '.5' AS cfg, CAST(p_partkey AS VARCHAR) AS seed, 'calm' AS mood, 'Style' || p_partkey%5 || ':0.8,Other' || p_partkey%3 || ':-' AS loras FROM part"""))
def _block(s, d):
    p = blocks(s, d).select("hash", pm.parse_params_block(F.col("block")).alias("p"))
    return p.select("hash", "p.prompt", "p.negative_prompt", "p.checkpoint", "p.generator", F.col("p.params")["steps"].alias("steps"), F.col("p.params")["cfgScale"].alias("cfg"), F.col("p.params")["seed"].alias("seed"),
                    F.col("p.extra")["Mood"].alias("mood"), F.array_join(F.transform("p.loras", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["weight"].cast("string"), F.lit("-")))), ",").alias("loras"))


query("parse_param_fields", duck("", """SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, unnest(['steps', 'sampler', 'cfgScale', 'seed', 'model', 'loraHashes', 'version']) AS key,
  unnest([CAST(p_size AS VARCHAR), 'Euler a', CAST(1+p_partkey%9 AS VARCHAR) || '.5', CAST(p_partkey AS VARCHAR), p_brand, 'Style' || p_partkey%5 || ': ab, Other' || p_partkey%3 || ': cd', CASE WHEN p_partkey%2=0 THEN 'f2.0' ELSE 'v1.9' END]) AS value FROM part"""))(lambda s, d: blocks(s, d).select("hash", pm.parse_param_fields(F.element_at(F.split("block", "\n"), -1)).alias("f")).select("hash", F.explode("f.params")))
query("loras", duck("", """SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, 'Style' || p_partkey%5 AS name, 0.8::DOUBLE AS weight FROM part UNION ALL SELECT md5(CAST(p_partkey AS VARCHAR)), unnest(['A','B']), NULL FROM part"""))(lambda s, d: blocks(s, d).select("hash", F.explode(pm.loras(F.col("block"), F.lit('"A: x, B: y"')))).select("hash", "col.*"))


def chunk_rows(s, d):
    """Text chunks per part: parameter block, comment JSON, workflow graph or nothing."""
    base = v.texts(s, d, "part", "p_partkey").select(F.md5(_text(key())).alias("hash"), "p_partkey", block_text().alias("block"), graph_text().alias("graph"))
    comment = F.concat(F.lit('{"prompt":"nai '), _text(key()), F.lit('","uc":"bad","steps":'), _text(key() % 50), F.lit(',"scale":NaN,"seed":'), _text(key()), F.lit(',"width":512,"height":768}'))
    chunks = (F.when(key() % 4 == 0, F.create_map(F.lit("parameters"), F.col("block"), F.lit("workflow"), F.lit("{}")))
              .when(key() % 4 == 1, F.create_map(F.lit("Comment"), comment, F.lit("Source"), F.lit("model"))).when(key() % 4 == 2, F.create_map(F.lit("prompt"), F.col("graph"))).otherwise(F.create_map().cast("map<string,string>")))
    return base.select("hash", "p_partkey", chunks.alias("chunks"), F.concat(F.lit("cache/"), "hash").alias("file_path"), F.lit(1).cast("long").alias("file_size"), F.lit(START).cast("long").alias("file_mtime"))


query("parse_comment_json", duck("", """SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, 'nai ' || p_partkey AS prompt, 'bad' AS negative_prompt, CAST(p_partkey%50 AS VARCHAR) AS steps, NULL::VARCHAR AS cfg, '512x768' AS size FROM part WHERE p_partkey%4=1"""))(
    lambda s, d: chunk_rows(s, d).filter(F.map_contains_key("chunks", "Comment")).select("hash", pm.parse_comment_json(F.col("chunks")).alias("c")).select(
        "hash", "c.prompt", "c.negative_prompt", F.col("c.params")["steps"].alias("steps"), F.try_element_at("c.params", F.lit("cfgScale")).alias("cfg"), F.col("c.params")["size"].alias("size")))
query("relax_json", duck("", """SELECT p_partkey, '{"a":null,"b":"NaN, -Infinity ' || p_name || '","c":[null, ' || p_size || CASE WHEN p_partkey%2=0 THEN ', null' ELSE '' END || ']}' AS relaxed FROM part"""))(
    lambda s, d: v.table(s, d, "part").select("p_partkey", pm.relax_json(F.concat(F.lit('{"a":-Infinity,"b":"NaN, -Infinity '), F.col("p_name"), F.lit('","c":[NaN, '), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ", Infinity").otherwise(""), F.lit("]}"))).alias("relaxed")))


@query("detect_metadata", duck("", """SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, CASE p_partkey%4 WHEN 0 THEN 'forge' WHEN 1 THEN 'nai' WHEN 2 THEN 'comfyui' ELSE 'unknown' END AS generator,
  CASE p_partkey%4 WHEN 0 THEN p_name || ', <lora:Style' || p_partkey%5 || ':0.8>, <lora:none:1>' WHEN 1 THEN 'nai ' || p_partkey WHEN 2 THEN 'a photo of ' || p_name ELSE '' END AS prompt FROM part"""))
def _detect(s, d):
    return hv.parse_originals(chunk_rows(s, d)).select("hash", "generator", "prompt")


# ---- graphs ----
def graph_text():
    """Text passes through one or two nodes; a dead sampler comes first, the checkpoint is
    preceded by an output name, styles sit in three places."""
    name = F.col("p_name")
    hop = F.when(key() % 2 == 0, F.lit('["6",0]')).otherwise(F.lit('["9",0]'))
    return F.concat(
        F.lit('{"3":{"class_type":"KSampler","inputs":{"seed":'), _text(key()), F.lit(',"steps":'), _text(F.col("p_size")), F.lit(',"cfg":7.5,"sampler_name":"euler","scheduler":"normal","denoise":NaN,"positive":'), hop,
        F.lit(',"negative":["7",0],"model":["4",0]}},"2":{"class_type":"Sampler Dead","inputs":{"positive":["4",1],"negative":["4",1]}},"4":{"class_type":"Loader","inputs":{"ckpt_name":"ComfyUI_0001_.safetensors","unet_name":"'),
        F.col("p_brand"), F.lit('.safetensors","lora_name":"style-'), _text(key() % 9), F.lit('","strength_model":0.7,"slot":{"on":true,"lora":"slot-a","strength":0.5},"off":{"on":false,"lora":"slot-b"},"state":"[{\\"name\\":\\"listed\\",\\"weight\\":1.5},{\\"name\\":\\"skip\\",\\"on\\":false}]"}},'
                                                              '"5":{"class_type":"Latent","inputs":{"width":832,"height":1216}},"6":{"class_type":"Encode","inputs":{"clip":["4",1],"text":"a photo of '), name,
        F.lit('"}},"7":{"class_type":"Encode","inputs":{"text":["8",0]}},"8":{"class_type":"Primitive","inputs":{"value":"ugly"}},"9":{"class_type":"Pass","inputs":{"model":["4",0],"conditioning":["10",0]}},"10":{"class_type":"Pass","inputs":{"conditioning":["6",0],"back":["9",0]}}}'))


def graphs(s, d):
    """A workflow per part."""
    return v.texts(s, d, "part", "p_partkey").select(F.md5(_text(key())).alias("hash"), graph_text().alias("graph"))


query("graph_tables", duck("", """SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, 9 AS nodes FROM part"""))(lambda s, d: gr.graph_tables(graphs(s, d))[0].groupBy("hash").agg(F.count(F.lit(1)).alias("nodes")))
query("graph_edges", duck("", "SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, 11 AS edges FROM part"))(lambda s, d: gr.graph_tables(graphs(s, d))[2].groupBy("hash").agg(F.count(F.lit(1)).alias("edges")))
query("pick_sampler", duck("", "SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, '3' AS node_id, 'a photo of ' || p_name AS prompt, 'ugly' AS negative_prompt FROM part"))(lambda s, d: gr.pick_sampler(gr.graph_inputs(graphs(s, d))))
query("resolve_text", duck("", "SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, 'r' AS root, 'a photo of ' || p_name AS text FROM part"))(
    lambda s, d: gr.resolve_text(gr.graph_inputs(graphs(s, d)), graphs(s, d).select("hash", F.lit("r").alias("root"), F.lit("9").alias("node_id"))))
query("graph_assets", duck("", "SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, p_brand || '.safetensors' AS checkpoint, 'style-' || p_partkey%9 || ':0.7,slot-a:0.5,listed:1.5' AS loras FROM part"))(
    lambda s, d: gr.graph_assets(gr.graph_inputs(graphs(s, d))).select("hash", "checkpoint", F.array_join(F.transform("loras", lambda x: F.concat(x["name"], F.lit(":"), x["weight"].cast("string"))), ",").alias("loras")))


@query("graph_params", duck("", "SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, CAST(p_size AS VARCHAR) AS steps, '7.5' AS cfg, 'euler' AS sampler, CAST(p_partkey AS VARCHAR) AS seed, '832x1216' AS size FROM part"))
def _graph_params(s, d):
    inputs = gr.graph_inputs(graphs(s, d))
    p = gr.graph_params(inputs, gr.pick_sampler(inputs))
    return p.select("hash", *[F.col("params")[k].alias(n) for k, n in [("steps", "steps"), ("cfgScale", "cfg"), ("sampler", "sampler"), ("seed", "seed"), ("size", "size")]])


def ui_graphs(s, d):
    text = F.concat(F.lit('{"nodes":[{"type":"CheckpointLoader","widgets_values":["'), F.col("p_brand"), F.lit('.ckpt"]},{"type":"LoraLoader","widgets_values":["fine.safetensors",0.8]},{"type":"CLIPTextEncode","widgets_values":["a long text about '),
                    F.col("p_name"), F.lit('"]},{"type":"CLIPTextEncode","widgets_values":["nothing ugly please"]}]}'))
    return v.texts(s, d, "part", "p_partkey").select(F.md5(_text(key())).alias("hash"), text.alias("workflow"))


query("ui_graph", duck("", "SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, p_brand || '.ckpt' AS checkpoint, 'fine.safetensors' AS loras, 'a long text about ' || p_name AS prompt, 'nothing ugly please' AS negative_prompt FROM part"))(
    lambda s, d: gr.ui_graph(ui_graphs(s, d)).withColumn("loras", F.array_join(F.transform("loras", lambda x: x["name"]), ",")))


# ---- sources ----
def raw_with_members(s, d):
    rows = v.heads(s, d).select("group_id", "row_id", F.concat(F.lit("u"), "speaker_uin").alias("sender_uid"))
    users = v.heads(s, d).select("group_id", F.concat(F.lit("u"), "speaker_uin").alias("uid"), "speaker_uin").distinct()
    known = users.filter(F.col("speaker_uin").cast("long") % 7 != 0)
    return rows, known.select("group_id", "uid", F.when(F.col("speaker_uin").cast("long") % 2 == 0, "").otherwise(F.concat(F.lit("card-"), "speaker_uin")).alias("card"), F.concat(F.lit("nick-"), "speaker_uin").alias("nickname"))


query("with_names", duck("heads group_names", """SELECT h.row_id, CASE WHEN CAST(speaker_uin AS BIGINT)%7=0 THEN '' WHEN CAST(speaker_uin AS BIGINT)%2=0 THEN 'nick-' || speaker_uin ELSE 'card-' || speaker_uin END AS member_name, coalesce(n.name,'') AS group_name FROM heads h LEFT JOIN group_names n ON n.group_id=h.group_id"""))(
    lambda s, d: src.with_names(*raw_with_members(s, d), v.group_names(s, d)).select("row_id", "member_name", "group_name"))


def export_docs(s, d):
    """One export document per (group, local day) built from the events."""
    m = v.heads(s, d).withColumn("day", F.floor((F.col("sent_at") - START) / 86400).cast("long"))
    body = F.struct(F.col("group_id").alias("groupId"), F.expr("cast(input_order as string)").alias("rowId"), F.col("sent_at").alias("sentAt"), F.col("speaker_uin").alias("senderUin"), F.col("speaker").alias("senderName"),
                    F.concat(F.lit("  text "), "row_id").alias("text"))
    shown = F.struct(F.col("group_id").alias("groupId"), F.expr("cast(input_order as string)").alias("rowId"), F.col("sent_at").alias("sentAt"), F.col("speaker_uin").alias("senderUin"), F.col("speaker").alias("senderName"),
                     F.array(F.struct(F.lit("image").alias("kind"), F.md5("row_id").alias("hash"), F.concat("row_id", F.lit(".png")).alias("fileName"))).alias("mediaRefs"))
    docs = m.groupBy("group_id", "day").agg(F.collect_list(F.when(F.col("is_media") == 0, body)).alias("messages"), F.collect_list(F.when(F.col("is_media") == 1, shown)).alias("mediaMessages"))
    start = F.lit(START) + F.col("day") * 86400
    whole = F.to_json(F.struct(F.array("group_id").alias("groupIds"), F.create_map("group_id", F.concat(F.lit("name "), "group_id")).alias("groupNames"), start.alias("startUnix"), (start + 86400).alias("endUnix"), "messages", "mediaMessages"))
    covered = F.when(F.col("day") % 3 == 1, F.concat(F.lit('{"coveredFromUnix":null,'), F.expr("substring(_w, 2)"))).when(F.col("day") % 3 == 2, F.concat(F.lit('{"coveredFromUnix":'), (start + 3600).cast("string"), F.lit(","), F.expr("substring(_w, 2)"))).otherwise(F.col("_w"))
    return docs.withColumn("_w", whole).select(F.concat_ws("-", "group_id", F.col("day").cast("string")).alias("file"), covered.alias("value"))


def exploded(s, d):
    return src.explode_exports(src.parse_exports(export_docs(s, d)))


query("read_exports", duck("heads", "SELECT group_id, row_id, sent_at, speaker, CASE WHEN is_media=1 THEN row_id || '.png' ELSE 'text ' || row_id END AS text, is_media, media_kinds FROM heads"))(
    lambda s, d: exploded(s, d)["text"].unionByName(exploded(s, d)["media"]).select("group_id", "row_id", "sent_at", "speaker", "text", "is_media", "media_kinds"))


def exports_in_splits(s, d):
    """The documents as files, each read in splits."""
    folder = f"{shared_folder(s)}/exports-{uuid4().hex}"
    export_docs(s, d).repartition("file").write.partitionBy("file").text(folder)
    return src.read_exports(s, f"{folder}/*", whole=0)


query("read_exports_in_splits", ORACLES["read_exports"])(
    lambda s, d: (lambda t: t["text"].unionByName(t["media"]))(exports_in_splits(s, d)).select("group_id", "row_id", "sent_at", "speaker", "text", "is_media", "media_kinds"))
query("export_coverage", duck("heads", f"SELECT group_id, {START}+day*86400+CASE WHEN day%3=2 THEN 3600 ELSE 0 END AS start_unix, {START}+(day+1)*86400 AS end_unix FROM (SELECT DISTINCT group_id, (sent_at-{START})//86400 AS day FROM heads) WHERE day%3<>1"))(
    lambda s, d: up.append_coverage(exploded(s, d)["scans"]).select("group_id", "start_unix", "end_unix"))


# ---- runs ----
def run_exports(s, d):
    k = F.col("o_orderkey")
    start = F.lit(START) + k * 60
    return v.table(s, d, "orders").select(F.concat(F.lit("run-"), (F.col("o_custkey") % 200).cast("string")).alias("run_id"), start.alias("start_unix"), (start + 7200).alias("end_unix"), (1 + k % 3).alias("group_count"),
                                          (k % 5 != 0).alias("has_covered"), F.when(k % 5 != 1, start + (k % 9000)).alias("covered_from"))


_SCAN = f"""SELECT run_id, CASE WHEN c/CAST(t AS DOUBLE)>=0.999 THEN 'complete' WHEN c>0 THEN 'partial' ELSE 'none' END AS scan_status, round(c/CAST(t AS DOUBLE),6) AS scan_ratio, CAST(c AS BIGINT) AS covered_seconds, CAST(t-c AS BIGINT) AS missing_seconds, a AS requested_start, b AS requested_end FROM (
  SELECT run_id, sum(7200*g) AS t, sum((e-CASE WHEN f IS NULL THEN e ELSE greatest(s,least(e,f)) END)*g) AS c, min(s) AS a, max(e) AS b FROM (SELECT 'run-' || o_custkey%200 AS run_id, {START}+o_orderkey*60 AS s, {START}+o_orderkey*60+7200 AS e, 1+o_orderkey%3 AS g,
  CASE WHEN o_orderkey%5=0 THEN {START}+o_orderkey*60 WHEN o_orderkey%5=1 THEN NULL ELSE {START}+o_orderkey*60+o_orderkey%9000 END AS f FROM orders) GROUP BY 1)"""
query("run_scan_coverage", duck("", _SCAN))(lambda s, d: rn.run_scan_coverage(run_exports(s, d)))


def analyses(s, d):
    k = F.col("o_orderkey")
    return v.table(s, d, "orders").select(F.concat(F.lit("run-"), (F.col("o_custkey") % 200).cast("string")).alias("run_id"), (k % 100).alias("total"), F.when(F.col("o_custkey") % 200 != 7, F.least(k % 100, F.lit(80))).alias("included"), (F.col("o_custkey") % 200 > 3).alias("used"))


_AI = """SELECT run_id, CASE WHEN NOT u THEN 'not-used' WHEN x THEN 'unknown' WHEN t=0 THEN 'empty' WHEN i/CAST(t AS DOUBLE)>=0.999 THEN 'complete' ELSE 'partial' END AS ai_status, CASE WHEN u AND NOT x THEN CASE WHEN t=0 THEN 1.0 ELSE round(i/CAST(t AS DOUBLE),6) END END AS ai_ratio,
  CAST(CASE WHEN NOT u THEN 0 WHEN NOT x THEN i END AS BIGINT) AS included_messages, CAST(CASE WHEN NOT u THEN 0 ELSE t END AS BIGINT) AS total_messages FROM (SELECT 'run-' || c AS run_id, c>3 AS u, c=7 AS x, sum(k) AS t, sum(least(k,80)) AS i FROM (SELECT o_custkey%200 AS c, o_orderkey%100 AS k FROM orders) GROUP BY c)"""
query("run_ai_coverage", duck("", _AI))(lambda s, d: rn.run_ai_coverage(analyses(s, d)))


def run_manifest(s, d):
    e = F.col("input_order")
    return v.media_index(s, d).select("run_id", F.when(e % 3 == 0, F.col("web_path")).alias("copied_path"), F.when(e % 3 == 1, F.lit("http://x")).alias("url"))


query("manifest_counters", duck("media_index", "SELECT run_id, count(*) AS refs, count(*) FILTER (input_order%3=0) AS copied, count(*) FILTER (input_order%3=2) AS missing, count(*) FILTER (input_order%3=1) AS url_only FROM media_index GROUP BY 1"))(lambda s, d: rn.manifest_counters(run_manifest(s, d)))


def run_list(s, d):
    """Runs by scan run id with their message counts; groups as an id list."""
    rows = v.media_index(s, d)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("text_messages"), F.sum(F.when(F.col("kind") == "video", 1).otherwise(0)).alias("media_messages"), F.max("sent_at").alias("modified_unix"), F.sort_array(F.collect_set("group_id")).alias("group_ids"))


def listing(s, d):
    by_group = v.media_index(s, d).groupBy("run_id", F.col("group_id").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    summary = rn.run_summary(by_group.withColumnRenamed("name", "n").select("run_id", F.col("n").alias("name"), "count"), run_list(s, d).select("run_id", F.lit("").alias("summary")))
    return rn.run_rows(run_list(s, d), rn.run_scan_coverage(run_exports(s, d)), rn.run_ai_coverage(analyses(s, d)), rn.manifest_counters(run_manifest(s, d)), rn.run_label(by_group), summary)


query("run_rows", duck("media_index", f"""SELECT r.run_id, r.m AS created_unix, r.n AS text_messages, r.vid AS media_messages, l.groups, l.summary, coalesce(s.scan_status,'unknown') AS scan_status, s.scan_ratio, coalesce(a.ai_status,'not-used') AS ai_status, c.refs, c.copied, c.missing, c.url_only FROM (
  SELECT run_id, count(*) AS n, count(*) FILTER (kind='video') AS vid, max(sent_at) AS m FROM media_index GROUP BY 1) r LEFT JOIN ({_SCAN}) s ON s.run_id=r.run_id LEFT JOIN ({_AI}) a ON a.run_id=r.run_id
  JOIN (SELECT run_id, count(*) AS refs, count(*) FILTER (input_order%3=0) AS copied, count(*) FILTER (input_order%3=2) AS missing, count(*) FILTER (input_order%3=1) AS url_only FROM media_index GROUP BY 1) c ON c.run_id=r.run_id
  JOIN (SELECT run_id, string_agg(group_id || ' (' || n || ')', ', ' ORDER BY k) AS groups, string_agg(group_id, ' / ' ORDER BY k) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, group_id) AS k FROM (SELECT run_id, group_id, count(*) AS n FROM media_index GROUP BY 1,2)) WHERE k<=3 GROUP BY 1) l ON l.run_id=r.run_id"""))(
    lambda s, d: listing(s, d).drop("group_ids"))
query("runs_total", duck("media_index", "SELECT count(DISTINCT run_id) AS runs, count(*) AS text_messages, count(*) FILTER (kind='video') AS media_messages, count(*) FILTER (input_order%3=0) AS copied, count(*) FILTER (input_order%3=2) AS missing FROM media_index"))(lambda s, d: rn.runs_total(listing(s, d)))
query("runs_filter", duck("media_index", "SELECT DISTINCT run_id FROM media_index WHERE group_id='1003' AND run_id LIKE '%run-%'"))(lambda s, d: rn.runs_filter(listing(s, d), " RUN-", "1003", None).select("run_id"))
query("expired_runs", duck("media_index", f"SELECT run_id, m AS created_unix FROM (SELECT 'day-' || (sent_at-{START})//86400 AS run_id, max(sent_at) AS m FROM media_index GROUP BY 1) WHERE m < {v.END}-10*86400"))(
    lambda s, d: up.expired_runs(v.media_index(s, d).groupBy(F.concat(F.lit("day-"), F.floor((F.col("sent_at") - START) / 86400).cast("string")).alias("run_id")).agg(
        F.max("sent_at").alias("modified_unix")), v.END, 10).select("run_id", "created_unix"))
query("storage_by_category", duck("", "SELECT CASE size%4 WHEN 0 THEN 'Pic' WHEN 1 THEN 'media' WHEN 2 THEN 'analysis' ELSE 'other' END AS category, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM files GROUP BY 1", files=FILES))(
    lambda s, d: rn.storage_by_category(files(s, d).withColumn("path", F.concat(F.when(F.col("size") % 4 == 0, "/runs/r1/").when(F.col("size") % 4 == 1, "/runs/r2/media/").when(F.col("size") % 4 == 2, "/runs/r3/analysis/").otherwise("/elsewhere/"), "path"))))


# ---- digest ----
def views_of(s, d):
    named = named_topics(s, d)
    header = ct.analysis_header(v.heads(s, d).filter("is_media = 0"), v.chat_media(s, d), v.group_names(s, d))
    none = v.group_names(s, d).limit(0).select("group_id", F.col("name").alias("summary"))
    return dg.group_views(header, named, none), named


query("group_views")(lambda s, d: views_of(s, d)[0])
query("digest_overview", duck("heads chat_media", "SELECT count(*) AS group_count, CAST(sum(t) AS BIGINT) AS text_messages, (SELECT count(DISTINCT (group_id, row_id)) FROM chat_media) AS media_messages, CAST(0 AS BIGINT) AS summarised_groups FROM (SELECT group_id, count(*) FILTER (is_media=0) AS t FROM heads GROUP BY 1)"))(lambda s, d: dg.overview(views_of(s, d)[0]))
query("overview_entries")(lambda s, d: dg.overview_entries(views_of(s, d)[0]))
query("sort_groups", duck("heads", "SELECT group_id, row_number() OVER (ORDER BY n DESC, group_id) AS rank FROM (SELECT group_id, count(*) AS n FROM heads WHERE is_media=0 GROUP BY 1)"))(
    lambda s, d: dg.sort_groups(ct.analysis_header(v.heads(s, d).filter("is_media = 0"), v.chat_media(s, d), v.group_names(s, d))).select("group_id", "rank"))
query("sort_risks", duck("", "SELECT CAST(o_orderkey AS VARCHAR) AS group_id, CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 3 END AS BIGINT) AS place FROM orders"))(
    lambda s, d: dg.sort_risks(v.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("group_id"), F.when(F.col("o_orderpriority").startswith("1"), "high").otherwise("odd").alias("severity"))).select("group_id", "place"))
query("sort_actions", f"SELECT group_id, task, status, CAST(CASE WHEN status='resolved' THEN 1 ELSE 0 END AS BIGINT) AS place FROM ({ORACLES['merge_actions']})")(lambda s, d: dg.sort_actions(ch.merge_actions(ch.normalize_summary(partial_answers(s, d)))).select("group_id", "task", "status", "place"))


@query("digest_lines")
def _digest(s, d):
    views, named = views_of(s, d)
    actions = ch.merge_actions(ch.normalize_summary(partial_answers(s, d))).withColumn("group_id", (F.lit(1001) + F.col("group_id").cast("long") % 25).cast("string"))
    risks = actions.select("group_id", F.lit("high").alias("severity"), F.col("task").alias("risk"), "evidence")
    links = v.table(s, d, "pages").select((F.lit(1001) + F.col("page_id") % 25).cast("string").alias("group_id"), (F.lit(START) + F.col("page_id")).alias("sent_at"), F.lit("someone").alias("speaker"), "url")
    return dg.digest_lines(views, named, actions, risks, links)


query("coverage_notes", duck("", "SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN 'the scan row budget was used up; messages of the requested range may be missing' WHEN o_orderkey%4=1 THEN 'read errors stopped the scan early; messages before x may be missing' END AS warning, CASE WHEN o_orderkey%3=0 THEN 'summary covers all 10 in 2 parts' WHEN o_orderkey%3=1 THEN 'summary covers 5/10 in 2 parts' ELSE 'summary rests on the latest 5/10' END AS basis FROM orders"))(
    lambda s, d: v.table(s, d, "orders").select("o_orderkey", val.scan_warning(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 4 == 1, F.when(F.col("o_orderkey") % 4 == 1, "x")).alias("warning"),
                                                val.summary_basis(F.when(F.col("o_orderkey") % 3 == 2, "single").otherwise("mapreduce"), F.lit(10), F.lit(5), F.lit(2), F.col("o_orderkey") % 3 == 1).alias("basis")))
query("normalize_watchlist", duck("", "SELECT CAST(c_custkey AS VARCHAR) AS group_id, c_name AS name FROM customer WHERE c_custkey%3<>0"))(
    lambda s, d: val.normalize_watchlist(v.table(s, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("group_id"), F.col("c_name").alias("name"))))
query("normalize_group_sets", duck("", "SELECT c_custkey AS set_order, trim(c_name) AS name, CAST(c_custkey AS VARCHAR) || ',7' AS group_ids FROM customer WHERE c_custkey%2=0 AND c_custkey<>7 ORDER BY c_custkey LIMIT 20"))(
    lambda s, d: val.normalize_group_sets(v.table(s, d, "customer").select(F.col("c_custkey").alias("set_order"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name")).otherwise(" ").alias("name"), F.array(F.col("c_custkey").cast("string"), F.lit(" 7 "), F.lit("7"), F.lit("x")).alias("group_ids"))).withColumn("group_ids", F.array_join("group_ids", ",")))


# ---- durable media ----
def media_entries(s, d):
    k = F.col("input_order")
    return v.chat_media(s, d).select("hash", F.when(k % 4 != 0, F.concat(F.lit("Pic/2024-01/Ori/"), "hash", F.lit(".png"))).alias("copied_path"), F.when(k % 5 == 0, "not-found").otherwise("downloaded").alias("remote_status"), k.alias("position"))


@query("reconcile_media", duck("chat_media images", f"""SELECT hash, status, CASE WHEN status IN ('reused','stored') AND known IS NULL AND gen<>'unknown' THEN 'discovered' WHEN status IN ('reused','stored') AND known='stripped' AND gen<>'unknown' THEN 'upgraded' ELSE 'none' END AS change,
  CASE WHEN status IN ('reused','stored') THEN coalesce(object_path, 'objects/' || hash[1:2] || '/' || hash) END AS object_path FROM (
  SELECT c.*, i.generator AS known, o.object_path, i.generator IS NULL AND o.object_path IS NULL AS fresh,
    CASE WHEN i.generator IS NULL AND o.object_path IS NULL AND (coalesce(c.remote,'')<>'downloaded' OR c.md5 IS NULL) THEN 'untracked'
         WHEN i.generator IS NULL AND o.object_path IS NULL AND c.md5<>c.hash THEN 'hash-mismatch' WHEN i.generator IS NULL AND o.object_path IS NULL AND NOT coalesce(c.gen<>'unknown',false) THEN 'untracked'
         WHEN o.object_path IS NOT NULL THEN 'reused' WHEN c.md5 IS NULL THEN 'source-missing' WHEN c.md5<>c.hash THEN 'hash-mismatch' ELSE 'stored' END AS status
  FROM (SELECT DISTINCT ON (e.hash) e.hash, e.remote, f.md5, f.gen FROM (
      SELECT hash, CASE WHEN input_order%4<>0 THEN 'Pic/2024-01/Ori/' || hash || '.png' END AS path, CASE WHEN input_order%5=0 THEN 'not-found' ELSE 'downloaded' END AS remote, input_order FROM chat_media) e
    LEFT JOIN (SELECT path, CASE WHEN size%7000=0 THEN repeat('0',32) ELSE regexp_extract(path,'[a-f0-9]{{32}}') END AS md5, CASE WHEN size%3000=0 THEN 'unknown' ELSE 'webui' END AS gen FROM files) f ON f.path=e.path
    ORDER BY e.hash, f.md5 IS NULL, e.input_order) c
  LEFT JOIN (SELECT * FROM images WHERE generator<>'nai') i ON i.hash=c.hash LEFT JOIN (SELECT hash, object_path FROM images WHERE object_path<>'') o ON o.hash=c.hash)""", files=FILES))
def _reconcile(s, d):
    digests = files(s, d).select("path", F.when(F.col("size") % 7000 == 0, F.lit("0" * 32)).otherwise(F.regexp_extract("path", "[a-f0-9]{32}", 0)).alias("md5"), F.when(F.col("size") % 3000 == 0, "unknown").otherwise("webui").alias("generator"))
    objects = v.images(s, d).filter("object_path <> ''").select("hash", "object_path")
    return up.reconcile_media(media_entries(s, d), v.images(s, d).filter("generator <> 'nai'"), objects, digests)


@query("harvest")
def _harvest(s, d):
    store = {"images": v.images(s, d), "sightings": v.named_sightings(s, d).withColumn("speaker_uin", F.lit("")), "scan_state": v.images(s, d).limit(0).select("file_path", "file_size", "file_mtime", "parser_version"),
             "requests": request_rows(s, d).withColumn("answer_media", F.array().cast("array<struct<kind:string,hash:string,file_name:string>>"))}
    out = hv.harvest(v.chat_text(s, d), v.chat_media(s, d), v.quote_links(s, d), files(s, d), chunk_rows(s, d), store, v.END)
    return out["stats"]
