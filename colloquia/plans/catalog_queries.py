"""Queries over the asset catalog, its maintenance and its export."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from colloquia.functions import text as tx
from colloquia.functions import values as val
from colloquia.operators import catalog as cat
from colloquia.operators import export as ex
from colloquia.operators import upserts as up
from colloquia.operators.ordered import positions
from colloquia.plans import views as v
from colloquia.plans.content_queries import SPACE, rep, trim_sql
from colloquia.plans.media_queries import FILES, files
from colloquia.plans.registry import ORACLES, query
from colloquia.plans.views import START, duck
from colloquia.session import shared_folder
from colloquia.sources.lake import BATCH, EventLake, KeyedTable
from colloquia.sources.search import SearchIndex


def tags(s, d):
    return up.image_tags(v.images(s, d))


def requests(s, d):
    return v.requests(s, d)


_TAG = trim_sql(rep(rep(rep(rep("x", r"\\(.)", r"\1"), r"[{}\[\]()]", ""), r":\s*[\d.]+\s*$", ""), SPACE + "+", " "))
TAGS = rf"""SELECT DISTINCT hash, tag, 'prompt' AS source FROM (SELECT hash, unnest(list_transform(regexp_split_to_array(regexp_replace(prompt,'<[^>]*>',',','g'),'[,\n]'), lambda x: lower({_TAG}))) AS tag FROM images) WHERE length(tag) BETWEEN 1 AND 80"""
query("tags_from_prompt", duck("images", TAGS))(tags)
query("webui_flavor", duck("images", "SELECT hash, CASE WHEN generator='forge' THEN 'forge' WHEN generator='webui' THEN 'reforge' ELSE 'webui' END AS flavor FROM images"))(
    lambda s, d: v.images(s, d).select("hash", _flavor(F.when(F.col("generator") == "forge", "f2.0.1").when(F.col("generator") == "webui", "v1-ReForge").otherwise("v1.9")).alias("flavor")))


def _flavor(c):
    from colloquia.functions.params import webui_flavor
    return webui_flavor(c)


query("aspect", duck("images", "SELECT hash, CASE WHEN width/CAST(height AS DOUBLE) BETWEEN 0.95 AND 1.05 THEN 'square' WHEN width/CAST(height AS DOUBLE)>1.05 THEN 'landscape' ELSE 'portrait' END AS aspect FROM images"))(
    lambda s, d: v.images(s, d).select("hash", val.aspect("width", "height").alias("aspect")))
query("param_num", duck("images", "SELECT hash, CAST(json_extract_string(params_json,'$.cfgScale') AS DOUBLE) AS cfg, TRY_CAST(json_extract_string(params_json,'$.seed') AS DOUBLE) AS seed FROM images"))(
    lambda s, d: v.images(s, d).select("hash", val.param_num("params_json", "cfgScale").alias("cfg"), val.param_num("params_json", "seed").alias("seed")))
query("preview", duck("", "SELECT doc_id, substr(text,1,400) AS text, length(text)>400 AS truncated FROM documents"))(
    lambda s, d: v.texts(s, d, "documents", "doc_id").select("doc_id", tx.preview("text").alias("p")).select("doc_id", "p.*"))

# ---- filters: each spec runs over the whole catalog ----
SPECS = {
    "f_like": ({"checkpoints": ["brand#1"], "exclude_prompts": ["ring", "hot"]}, "contains(lower(checkpoint),'brand#1') AND NOT (contains(lower(prompt),'ring') OR contains(lower(prompt),'hot'))"),
    "f_generator": ({"generators": ["Forge", "nai", "webui"], "exclude_generators": ["WEBUI"]}, "generator IN ('forge','nai')"),
    "f_exists": ({"tags": ["gear", "bolt"], "loras": ["style-1", "detail"], "senders": ["supp-1"]},
                 "hash IN (SELECT hash FROM tags WHERE contains(tag,'gear') OR contains(tag,'bolt')) AND hash IN (SELECT hash FROM image_loras WHERE contains(lora_name,'style-1') OR contains(lora_name,'detail')) AND hash IN (SELECT hash FROM sightings WHERE contains(speaker,'supp-1'))"),
    "f_not_exists": ({"exclude_tags": ["gear"], "exclude_loras": ["detail-2"], "exclude_senders": ["supp-7"]},
                     "hash NOT IN (SELECT hash FROM tags WHERE contains(tag,'gear')) AND hash NOT IN (SELECT hash FROM image_loras WHERE contains(lora_name,'detail-2')) AND hash NOT IN (SELECT hash FROM sightings WHERE contains(speaker,'supp-7'))"),
    "f_group": ({"groups": ["1003", "an"]}, "hash IN (SELECT hash FROM named_sightings WHERE group_id IN ('1003','an') OR contains(lower(group_name),'1003') OR contains(lower(group_name),'an'))"),
    "f_seed": ({"seed": "17"}, "json_extract_string(params_json,'$.seed')='17'"),
    "f_range": ({"ranges": {"steps": (10, 30), "cfg": (3, None), "width": (640, 1024), "height": (None, 1152)}},
                "CAST(json_extract_string(params_json,'$.steps') AS DOUBLE) BETWEEN 10 AND 30 AND CAST(json_extract_string(params_json,'$.cfgScale') AS DOUBLE)>=3 AND width BETWEEN 640 AND 1024 AND height<=1152"),
    "f_aspect": ({"aspect": "landscape"}, "width/CAST(height AS DOUBLE)>1.05"),
    "f_date": ({"date_from": "2024-01-10", "date_to": "2024-02-03"}, "file_mtime>=1704844800 AND file_mtime<=1707004799"),
    "f_flags": ({"flags": {"prompt": True, "negative": False, "file": True, "lora": True, "sender": True, "answer": False}},
                "prompt<>'' AND NOT negative_prompt<>'' AND ((file_missing=0 AND file_path<>'') OR object_path<>'') AND hash IN (SELECT hash FROM image_loras) AND hash IN (SELECT hash FROM sightings) AND hash NOT IN (SELECT image_hash FROM requests WHERE answer_kind<>'' AND image_hash IS NOT NULL)"),
    "f_text": ({"text": "gea Brand"}, "hash IN (SELECT hash FROM tok WHERE starts_with(token,'gea')) AND hash IN (SELECT hash FROM tok WHERE starts_with(token,'brand'))"),
    "f_selection": ({"hashes": ["c4ca4238a0b923820dcc509a6f75849b", "bad", "c81e728d9d4c2f636f067f89cc14862c"], "generators": ["webui"]}, "hash IN ('c4ca4238a0b923820dcc509a6f75849b','c81e728d9d4c2f636f067f89cc14862c') AND generator='webui'"),
    "catalog_filter": ({"generator": "webui", "generators": ["forge"], "prompts": ["widget", "gear"], "exclude_loras": ["style-4"], "ranges": {"steps": (5, None)}, "flags": {"sender": True}, "text": "ge"},
                       "generator IN ('webui','forge') AND (contains(prompt,'widget') OR contains(prompt,'gear')) AND hash NOT IN (SELECT hash FROM image_loras WHERE contains(lora_name,'style-4')) AND CAST(json_extract_string(params_json,'$.steps') AS DOUBLE)>=5 AND hash IN (SELECT hash FROM sightings) AND hash IN (SELECT hash FROM tok WHERE starts_with(token,'ge'))"),
}
TOK = r"SELECT DISTINCT hash, token FROM (SELECT hash, unnest(regexp_split_to_array(lower(t),'[^\p{L}\p{N}]+')) AS token FROM (SELECT hash, prompt || ' ' || negative_prompt || ' ' || checkpoint AS t FROM images UNION ALL SELECT hash, lora_name FROM image_loras)) WHERE token<>''"
CATALOG = "images image_loras named_sightings requests"


def filtered(s, d, spec):
    return cat.catalog_filter(v.images(s, d), spec, tags(s, d), v.image_loras(s, d), v.named_sightings(s, d), requests(s, d))


for _name, (_spec, _cond) in SPECS.items():
    query(_name, duck(CATALOG, f"SELECT hash FROM images WHERE {_cond}", tags=TAGS, tok=TOK))(lambda s, d, sp=_spec: filtered(s, d, sp).select("hash"))


def indexed(s, d):
    """The stored index of the catalog: first without styles, then with them, as a later parse finds them."""
    index = SearchIndex(f"{shared_folder(s)}/search-{uuid4().hex}", 64)
    index.update(v.images(s, d), v.image_loras(s, d).limit(0))
    index.update(v.images(s, d), v.image_loras(s, d))
    return index


query("f_text_indexed", ORACLES["f_text"])(lambda s, d: indexed(s, d).search(v.images(s, d), SPECS["f_text"][0]["text"]).select("hash"))
query("search_tokens", duck("images image_loras", TOK))(lambda s, d: cat.search_tokens(v.images(s, d), v.image_loras(s, d)))

RECENCY = "coalesce((SELECT max(sent_at) FROM sightings x WHERE x.hash=i.hash), file_mtime)"
ORDERS = {"recent": f"{RECENCY} DESC, parsed_at DESC, hash DESC", "oldest": f"{RECENCY}, parsed_at, hash", "asked": "(SELECT count(*) FROM requests r WHERE r.image_hash=i.hash) DESC, file_mtime DESC, hash DESC",
          "loras": "(SELECT count(*) FROM image_loras l WHERE l.hash=i.hash) DESC, file_mtime DESC, hash DESC", "largest": "file_size DESC, hash DESC", "promptLength": "length(prompt) DESC, hash DESC"}
for _mode, _order in ORDERS.items():
    query(f"catalog_sort_{_mode}", duck("images sightings image_loras requests", f"SELECT *, row_number() OVER () AS position FROM (SELECT hash FROM images i ORDER BY {_order} LIMIT 60 OFFSET 30)"))(
        lambda s, d, m=_mode: positions(cat.catalog_page(v.images(s, d), m, v.image_loras(s, d), v.sightings(s, d), requests(s, d), None, 30)[0]).select("hash", "position"))
query("catalog_page", duck(CATALOG, f"SELECT *, row_number() OVER () AS position FROM (SELECT hash, file_size FROM images i WHERE generator='nai' ORDER BY {ORDERS['largest']} LIMIT 200 OFFSET 10)"))(
    lambda s, d: positions(cat.catalog_page(filtered(s, d, {"generators": ["nai"]}), "largest", v.image_loras(s, d), v.sightings(s, d), requests(s, d), 999, 10)[0]).select("hash", "file_size", "position"))
query("catalog_total", duck("images", "SELECT count(*) AS total FROM images WHERE generator='nai'"))(
    lambda s, d: cat.catalog_page(filtered(s, d, {"generators": ["nai"]}), "largest", v.image_loras(s, d), v.sightings(s, d), requests(s, d))[1])
query("export_rows", duck("images sightings", f"SELECT *, row_number() OVER () AS position FROM (SELECT hash, CASE WHEN file_missing<>1 AND file_path<>'' THEN file_path ELSE object_path END AS export_path FROM images i ORDER BY {ORDERS['recent']})"))(
    lambda s, d: positions(cat.export_rows(v.images(s, d), "recent", v.image_loras(s, d), v.sightings(s, d), requests(s, d))).select("hash", "export_path", "position"))

REASON = """SELECT hash, generator, CASE WHEN hash IN (SELECT hash FROM sightings) THEN 'attributed' WHEN object_path='' AND file_missing=1 THEN 'evicted' WHEN object_path='' AND file_path='' THEN 'unavailable'
  WHEN file_mtime>0 AND EXISTS (SELECT 1 FROM allr r WHERE i.file_mtime BETWEEN r.a AND r.b) THEN 'not-in-messages' ELSE 'outside-coverage' END AS reason FROM images i"""
ALLR = """SELECT min(start_unix) AS a, max(end_unix) AS b FROM (SELECT *, sum(CASE WHEN prev IS NULL OR start_unix>prev THEN 1 ELSE 0 END) OVER (ORDER BY start_unix, end_unix) AS blk FROM (
  SELECT *, max(end_unix) OVER (ORDER BY start_unix, end_unix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM scan_ranges)) GROUP BY blk"""
query("attribution_reason", duck("images sightings scan_ranges", "SELECT hash, reason FROM reasons", allr=ALLR, reasons=REASON))(
    lambda s, d: cat.attribution_reason(v.images(s, d), v.sightings(s, d), v.scan_ranges(s, d)).select("hash", "reason"))
query("reason_counts", duck("images sightings scan_ranges", "SELECT reason, count(*) AS images FROM reasons WHERE generator<>'stripped' GROUP BY 1", allr=ALLR, reasons=REASON))(
    lambda s, d: cat.reason_counts(v.images(s, d), v.sightings(s, d), v.scan_ranges(s, d)))
query("inside_coverage", duck("images scan_ranges", "SELECT hash, EXISTS (SELECT 1 FROM allr r WHERE i.file_mtime BETWEEN r.a AND r.b) AS inside FROM images i", allr=ALLR))(
    lambda s, d: cat.inside_coverage(v.images(s, d), v.scan_ranges(s, d)).select("hash", "inside"))
query("covered_span", duck("scan_ranges", "SELECT min(start_unix) AS from_unix, max(end_unix) AS to_unix, count(*) AS range_count FROM scan_ranges"))(lambda s, d: cat.covered_span(v.scan_ranges(s, d)))
query("catalog_summary", duck("images sightings image_loras requests", """SELECT unnest(['images','placeholders','with_prompt','file_missing','durable_media','attributed','sightings','loras','tags','requests','answered_requests']) AS counter, unnest([
  (SELECT count(*) FROM images WHERE generator<>'stripped'),(SELECT count(*) FROM images WHERE generator='stripped'),(SELECT count(*) FROM images WHERE prompt<>''),(SELECT count(*) FROM images WHERE file_missing=1 AND object_path=''),
  (SELECT count(*) FROM images WHERE object_path<>''),(SELECT count(DISTINCT hash) FROM sightings),(SELECT count(*) FROM sightings),(SELECT count(DISTINCT lora_name) FROM image_loras),(SELECT count(DISTINCT tag) FROM tags),(SELECT count(*) FROM requests),(SELECT count(*) FROM requests WHERE answer_kind<>'')]) AS value""", tags=TAGS))(
    lambda s, d: cat.catalog_summary(v.images(s, d), v.sightings(s, d), v.image_loras(s, d), tags(s, d), requests(s, d)))


def _facet(name, sql, n):
    return f"SELECT '{name}' AS facet, value, images, row_number() OVER (ORDER BY images DESC, value) AS rank FROM ({sql}) QUALIFY row_number() OVER (ORDER BY images DESC, value)<={n}"


_FACETS = " UNION ALL ".join(f"SELECT * FROM ({_facet(*a)})" for a in [
    ("generator", "SELECT generator AS value, count(*) AS images FROM images WHERE generator<>'stripped' GROUP BY 1", 1000000), ("group", "SELECT group_id AS value, count(DISTINCT hash) AS images FROM sightings GROUP BY 1", 30),
    ("sender", "SELECT speaker AS value, count(DISTINCT hash) AS images FROM sightings WHERE speaker<>'' GROUP BY 1", 40), ("checkpoint", "SELECT checkpoint AS value, count(*) AS images FROM images WHERE checkpoint<>'' GROUP BY 1", 20),
    ("lora", "SELECT lora_name AS value, count(*) AS images FROM image_loras GROUP BY 1", 20), ("tag", "SELECT tag AS value, count(*) AS images FROM tags GROUP BY 1", 40)])
query("facets", duck("images sightings image_loras", _FACETS, tags=TAGS))(lambda s, d: cat.facets(v.images(s, d), v.sightings(s, d), v.image_loras(s, d), tags(s, d)))
MONTHS = """SELECT m.*, EXISTS (SELECT 1 FROM scan_ranges r WHERE r.end_unix>=m.from_unix AND r.start_unix<=m.to_unix) AS summarised, images-attributed AS unattributed FROM (SELECT strftime(make_timestamp(file_mtime*1000000),'%Y-%m') AS month, count(*) AS images,
  count(*) FILTER (hash IN (SELECT hash FROM sightings)) AS attributed, count(*) FILTER (prompt<>'') AS with_prompt, min(file_mtime) AS from_unix, max(file_mtime) AS to_unix FROM images WHERE generator<>'stripped' AND file_mtime>0 GROUP BY 1) m"""
query("month_coverage", duck("images sightings scan_ranges", MONTHS))(lambda s, d: cat.month_coverage(v.images(s, d), v.sightings(s, d), v.scan_ranges(s, d)))
query("recoverable", duck("images sightings scan_ranges", "SELECT CAST(coalesce(sum(unattributed),0) AS BIGINT) AS recoverable, count(*) AS months FROM m WHERE NOT summarised", m=MONTHS))(
    lambda s, d: cat.recoverable(cat.month_coverage(v.images(s, d), v.sightings(s, d), v.scan_ranges(s, d))))
query("group_contribution", duck("named_sightings", "SELECT group_id, max(group_name) AS group_name, count(DISTINCT hash) AS images, min(sent_at) AS first_seen, max(sent_at) AS last_seen FROM named_sightings GROUP BY 1"))(
    lambda s, d: cat.group_contribution(v.named_sightings(s, d)))


def moved_sightings(s, d):
    """All sightings, those of the first five groups posted in the tenth instead, so some groups have none."""
    return v.named_sightings(s, d).withColumn("group_id", F.when(F.col("group_id") < "1006", "1010").otherwise(F.col("group_id")))


_MOVED = "SELECT * REPLACE (CASE WHEN group_id < '1006' THEN '1010' ELSE group_id END AS group_id) FROM named_sightings"
for _name, _strict in {"unattributed_groups": True, "unattributed_groups_listed": False}.items():
    _k = "SELECT DISTINCT group_id FROM moved" if _strict else "SELECT group_id FROM (SELECT group_id, count(DISTINCT hash) AS n FROM moved GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)"
    query(_name, duck("heads named_sightings group_names", f"""SELECT b.group_id, coalesce(n.name, b.group_id) AS group_name, b.media_messages FROM (SELECT group_id, CAST(sum(is_media) AS BIGINT) AS media_messages FROM heads GROUP BY 1 HAVING sum(is_media)>0) b
      LEFT JOIN group_names n ON n.group_id=b.group_id WHERE b.group_id NOT IN ({_k})""", moved=_MOVED))(lambda s, d, st=_strict: cat.unattributed_groups(v.heads(s, d), v.group_names(s, d), moved_sightings(s, d), st))
query("new_since", duck("images", f"SELECT max(file_mtime) AS watermark, count(*) FILTER (generator<>'stripped' AND file_mtime>{START+2592000}) AS new_images, count(*) FILTER (generator<>'stripped') AS images FROM images"))(
    lambda s, d: cat.new_since(v.images(s, d), START + 2592000))
_HAS = "(file_missing=0 AND file_path<>'') OR object_path<>''"
query("request_list", duck("images requests", f"""SELECT r.group_id, r.ask_row_id, i.hash IS NOT NULL AS image_known, coalesce({_HAS},false) AS image_has_file, coalesce(file_missing=1 AND object_path='',false) AS image_file_missing
  FROM (SELECT * FROM requests WHERE answer_kind<>'' ORDER BY ask_sent_at DESC, group_id, ask_row_id LIMIT 200) r LEFT JOIN images i ON i.hash=r.image_hash"""))(
    lambda s, d: cat.request_list(requests(s, d), v.images(s, d), True, 500).select("group_id", "ask_row_id", "image_known", "image_has_file", "image_file_missing"))


def media_requests(s, d):
    return requests(s, d).withColumn("answer_media", F.when(F.col("answer_hash").isNotNull(), F.array(F.struct(F.col("answer_hash").alias("hash")), F.struct(F.col("image_hash").alias("hash")))))


query("with_media_availability", duck("images requests", f"""SELECT r.group_id, r.ask_row_id, r.position, r.hash, coalesce({_HAS},false) AS has_file FROM (SELECT group_id, ask_row_id, CAST(0 AS BIGINT) AS position, answer_hash AS hash FROM requests WHERE answer_hash IS NOT NULL
  UNION ALL SELECT group_id, ask_row_id, 1, image_hash FROM requests WHERE answer_hash IS NOT NULL) r LEFT JOIN images i ON i.hash=r.hash"""))(
    lambda s, d: cat.with_media_availability(media_requests(s, d), v.images(s, d)).withColumn("position", F.col("position").cast("long")))
query("asset_cards", duck("images image_loras named_sightings requests", f"""SELECT i.hash, substr(i.prompt,1,400) AS prompt, {_HAS} AS has_file, coalesce(l.loras,'') AS loras, coalesce(s.seen,'') AS seen, coalesce(q.asked,'') AS asked FROM images i
  LEFT JOIN (SELECT hash, string_agg(DISTINCT lora_name, ',' ORDER BY lora_name) AS loras FROM image_loras GROUP BY 1) l ON l.hash=i.hash
  LEFT JOIN (SELECT hash, string_agg(speaker || '@' || sent_at, ',' ORDER BY r) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY sent_at, group_id, row_id) AS r FROM named_sightings) WHERE r<=8 GROUP BY 1) s ON s.hash=i.hash
  LEFT JOIN (SELECT image_hash, string_agg(asker || ':' || intent, ',' ORDER BY r) AS asked FROM (SELECT *, row_number() OVER (PARTITION BY image_hash ORDER BY ask_sent_at, group_id, ask_row_id) AS r FROM requests WHERE image_hash IS NOT NULL) WHERE r<=8 GROUP BY 1) q ON q.image_hash=i.hash"""))(
    lambda s, d: cat.asset_cards(v.images(s, d), v.image_loras(s, d), v.named_sightings(s, d), requests(s, d)).select(
        "hash", F.col("preview.text").alias("prompt"), "has_file", F.coalesce(F.array_join("loras", ","), F.lit("")).alias("loras"),
        F.coalesce(F.array_join(F.transform("sightings", lambda x: F.concat(x["speaker"], F.lit("@"), x["sent_at"].cast("string"))), ","), F.lit("")).alias("seen"),
        F.coalesce(F.array_join(F.transform("requests", lambda x: F.concat(x["asker"], F.lit(":"), x["intent"])), ","), F.lit("")).alias("asked")))


def manifest(s, d):
    """Manifest entries of the media index; every sixth lost its speaker."""
    eid = F.col("input_order")
    return v.media_index(s, d).select("run_id", F.col("content_key").alias("hash"), "group_id", F.lit("").alias("group_name"), F.when(eid % 7 == 0, F.concat(F.lit("x"), "row_id")).otherwise(F.col("row_id")).alias("row_id"),
                                      F.when(eid % 6 == 0, "").otherwise(F.col("speaker")).alias("speaker"), F.when(eid % 8 == 0, "").otherwise(F.col("web_path")).alias("copied_path"), eid.alias("position"))


MANIFEST = """SELECT run_id, content_key AS hash, group_id, CASE WHEN input_order%7=0 THEN 'x' || row_id ELSE row_id END AS row_id, CASE WHEN input_order%6=0 THEN '' ELSE speaker END AS speaker, CASE WHEN input_order%8=0 THEN '' ELSE web_path END AS copied_path, input_order AS position FROM media_index"""
_ATTR = """SELECT m.hash, m.group_id, m.row_id, coalesce(h.sent_at,0) AS sent_at, coalesce(nullif(m.speaker,''), h.speaker, '') AS speaker, coalesce(h.speaker_uin,'') AS speaker_uin, coalesce(n.name,'') AS group_name, h.sent_at IS NULL AS no_time FROM man m
  LEFT JOIN heads h ON h.is_media=1 AND h.group_id=m.group_id AND substr(h.row_id,2)=m.row_id LEFT JOIN group_names n ON n.group_id=m.group_id WHERE m.hash IN (SELECT hash FROM images)"""


def attributed(s, d):
    return cat.attribute(manifest(s, d), v.images(s, d), v.heads(s, d), v.group_names(s, d))


query("attribute", duck("heads media_index images group_names", _ATTR, man=MANIFEST))(attributed)
query("attribution_stats", duck("heads media_index images group_names", """SELECT 'matched' AS counter, count(*) AS value FROM a UNION ALL SELECT 'no_time', count(*) FILTER (no_time) FROM a UNION ALL SELECT 'unknown_hash', (SELECT count(*) FROM man WHERE hash NOT IN (SELECT hash FROM images))""", man=MANIFEST, a=_ATTR))(
    lambda s, d: cat.attribution_stats(manifest(s, d), v.images(s, d), attributed(s, d)))
_EFF = """SELECT i.*, coalesce(nullif(trim(prompt),''), a.t, '') AS effective_prompt, CASE WHEN trim(prompt)<>'' THEN 'metadata' WHEN a.t IS NOT NULL THEN 'chat' ELSE 'none' END AS prompt_source FROM images i
  LEFT JOIN (SELECT image_hash, arg_min(trim(answer_text), (ask_sent_at, group_id, ask_row_id)) AS t FROM requests WHERE trim(answer_text)<>'' AND image_hash IS NOT NULL GROUP BY 1) a ON a.image_hash=i.hash"""
query("effective_prompt", duck("images requests", "SELECT hash, effective_prompt, prompt_source FROM e", e=_EFF))(lambda s, d: cat.effective_prompt(v.images(s, d), requests(s, d)).select("hash", "effective_prompt", "prompt_source"))


# ---- maintenance ----
def parts(s, d):
    m = v.messages(s, d)
    text = m.filter("is_media = 0").select("group_id", "row_id", "sent_at", "speaker", "text", "speaker_uin")
    return text, m.filter("is_media = 1").select("group_id", F.expr("substring(row_id, 2)").alias("row_id"), "sent_at", "speaker", "text", "media_kinds", "speaker_uin")


query("to_messages", duck("messages", "SELECT group_id, row_id, sent_at, speaker, is_media, media_kinds, speaker_uin, md5(text) AS text FROM messages"))(lambda s, d: up.to_messages(*parts(s, d)).withColumn("text", F.md5("text")))


def delta(s, d):
    """Export rows that repeat, with some blank texts."""
    m = v.heads(s, d).withColumn("text", F.when(F.col("input_order") % 4 == 0, " \x07 ").otherwise(F.concat(F.lit("  hello   "), F.col("row_id"))))
    return m.unionByName(m.withColumn("input_order", F.col("input_order") + 1000000000))


query("ingest_messages", duck("heads", "SELECT group_id, row_id, CASE WHEN is_media=1 AND input_order%4=0 THEN 'bell' WHEN is_media=1 THEN '  hello   ' || row_id ELSE 'hello ' || row_id END AS text FROM heads WHERE (is_media=1 OR input_order%4<>0) AND input_order%5<>0"))(
    lambda s, d: up.ingest_messages(v.heads(s, d).filter("input_order % 5 = 0"), delta(s, d)).select("group_id", "row_id", F.when(F.col("text").contains("\x07"), "bell").otherwise(F.col("text")).alias("text")))


def scans(s, d):
    k = F.col("o_orderkey")
    start = F.lit(START) + k
    return v.table(s, d, "orders").select((F.lit(1001) + F.col("o_custkey") % 25).cast("string").alias("group_id"), start.alias("start_unix"), (start + 3600).alias("end_unix"), F.lit("r").alias("run_id"),
                                          (k % 3 != 0).alias("has_covered"), F.when(k % 3 == 1, start + (k % 7200)).alias("covered_from"))


query("append_coverage", duck("", f"""SELECT * FROM (SELECT CAST(1001+o_custkey%25 AS VARCHAR) AS group_id, CASE o_orderkey%3 WHEN 0 THEN {START}+o_orderkey WHEN 1 THEN {START}+o_orderkey+o_orderkey%7200 END AS start_unix, {START}+o_orderkey+3600 AS end_unix, 'r' AS run_id FROM orders) WHERE start_unix<end_unix"""))(
    lambda s, d: up.append_coverage(scans(s, d)))


def name_updates(s, d):
    k = F.col("o_orderkey")
    return v.table(s, d, "orders").select((F.lit(1001) + F.col("o_custkey") % 25).cast("string").alias("group_id"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("name-"), k.cast("string"))).alias("name"), k.alias("seq"))


query("upsert_names", duck("group_names", "SELECT group_id, coalesce(arg_max(name, seq) FILTER (name<>''),'') AS name FROM (SELECT group_id, name, -1 AS seq FROM group_names UNION ALL SELECT CAST(1001+o_custkey%25 AS VARCHAR), CASE WHEN o_orderkey%2=0 THEN '' ELSE 'name-' || o_orderkey END, o_orderkey FROM orders) GROUP BY 1"))(
    lambda s, d: up.upsert_names(v.group_names(s, d), name_updates(s, d)))
query("advance_marks", duck("heads read_marks", "SELECT group_id, m.sent_at AS sent_at, m.row_id AS row_id FROM (SELECT group_id, max({'sent_at': sent_at, 'row_id': row_id}) AS m FROM (SELECT group_id, sent_at, row_id FROM read_marks UNION ALL SELECT group_id, sent_at, row_id FROM heads WHERE event_type='error') GROUP BY 1)"))(
    lambda s, d: up.advance_marks(v.read_marks(s, d), v.heads(s, d).filter("event_type = 'error'")))
query("marks_to_latest", duck("heads read_marks", "SELECT group_id, m.sent_at AS sent_at, m.row_id AS row_id FROM (SELECT group_id, max({'sent_at': sent_at, 'row_id': row_id}) AS m FROM (SELECT group_id, sent_at, row_id FROM read_marks UNION ALL SELECT group_id, sent_at, row_id FROM heads) GROUP BY 1)"))(
    lambda s, d: up.marks_to_latest(v.heads(s, d), v.read_marks(s, d)))


def reparsed(s, d):
    """Records re-parsed from supplier deliveries: newest record per asset counts."""
    rows = v.table(s, d, "lineitem").select(F.md5(F.col("l_partkey").cast("string")).alias("hash"), F.concat(F.lit("again/"), F.col("l_orderkey").cast("string")).alias("file_path"), F.lit("webui").alias("generator"),
                                            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("parsed_at"), (F.lit(5000) + F.col("l_suppkey")).alias("file_size"))
    return rows.filter(F.col("file_size") > 5020)


query("upsert_images", duck("images", """SELECT i.hash, coalesce(n.file_path, i.file_path) AS file_path, coalesce(n.generator, i.generator) AS generator, CASE WHEN n.hash IS NOT NULL THEN 0 ELSE file_missing END AS file_missing, i.object_path FROM images i LEFT JOIN (
  SELECT md5(CAST(l_partkey AS VARCHAR)) AS hash, arg_max('again/' || l_orderkey, (l_orderkey*8+l_linenumber, l_suppkey)) AS file_path, 'webui' AS generator FROM lineitem WHERE l_suppkey>20 GROUP BY 1) n ON n.hash=i.hash"""))(
    lambda s, d: up.upsert_images(v.images(s, d).select("hash", "file_path", "generator", "parsed_at", "file_size", "file_missing", "object_path"), reparsed(s, d)).select("hash", "file_path", "generator", "file_missing", "object_path"))
query("replace_children", duck("images image_loras", "SELECT hash, lora_name FROM (SELECT * FROM image_loras WHERE hash NOT IN (SELECT hash FROM images WHERE generator='nai') UNION ALL SELECT hash, 'fresh' FROM images WHERE generator='nai')"))(
    lambda s, d: up.replace_children(v.image_loras(s, d), v.images(s, d).filter("generator='nai'"), v.images(s, d).filter("generator='nai'").select("hash", F.lit("fresh").alias("lora_name"))))


def sighting_delta(s, d):
    return v.sightings(s, d).select("hash", "group_id", "row_id", (F.col("sent_at") + 5).alias("sent_at"), F.concat(F.lit("new-"), "speaker").alias("speaker"), F.lit("u").alias("speaker_uin"),
                                    F.when(F.col("sent_at") % 2 == 0, "").otherwise("renamed").alias("group_name"), F.lit(1).cast("long").alias("seq")).filter("sent_at % 3 = 0")


query("upsert_sightings", duck("named_sightings", "SELECT hash, group_id, row_id, CASE WHEN t THEN sent_at+5 ELSE sent_at END AS sent_at, CASE WHEN t THEN 'new-' || speaker ELSE speaker END AS speaker, CASE WHEN t AND sent_at%2=1 THEN 'renamed' ELSE group_name END AS group_name FROM (SELECT *, (sent_at+5)%3=0 AS t FROM named_sightings)"))(
    lambda s, d: up.upsert_sightings(v.named_sightings(s, d).withColumn("speaker_uin", F.lit("")), sighting_delta(s, d)).drop("speaker_uin"))


def request_rows(s, d):
    empty = F.array().cast("array<struct<hash:string>>")
    return media_requests(s, d).select("group_id", "ask_row_id", "ask_sent_at", F.lit("").alias("group_name"), "intent", F.lit("exact").alias("rule"), "asker", F.lit("kkt").alias("ask_text"), "image_hash", F.lit("").alias("image_owner"),
                                       F.lit(0).cast("long").alias("image_sent_at"), F.lit("quote").alias("target_via"), F.lit("high").alias("confidence"), "answer_text", "answer_kind", F.coalesce("answer_media", empty).alias("answer_media"), F.lit("").alias("answer_by"), F.lit(0).cast("long").alias("answer_sent_at"))


def request_delta(s, d):
    """A later scan of all requests that saw no answers, no images and another rule."""
    return request_rows(s, d).withColumn("answer_kind", F.lit("")).withColumn("answer_text", F.lit("")).withColumn("image_hash", F.lit(None).cast("string")).withColumn("confidence", F.lit("low")).withColumn("group_name", F.lit("g")).withColumn("seq", F.lit(1).cast("long"))


query("upsert_requests", duck("requests", "SELECT group_id, ask_row_id, image_hash, answer_kind, answer_text, 'low' AS confidence, 'g' AS group_name FROM requests"))(
    lambda s, d: up.upsert_requests(request_rows(s, d), request_delta(s, d)).select("group_id", "ask_row_id", "image_hash", "answer_kind", "answer_text", "confidence", "group_name"))


def stored_twice(s, d):
    """Requests folded bucket by bucket into a keyed table, then their later scan."""
    table = KeyedTable(f"{shared_folder(s)}/requests-{uuid4().hex}", ("group_id", "ask_row_id"), 32)
    rows = request_rows(s, d)
    table.upsert(rows.withColumn("seq", F.lit(0).cast("long")), up.upsert_requests, rows)
    table.upsert(request_delta(s, d), up.upsert_requests, rows)
    return table.read(s, rows)


query("upsert_requests_by_bucket", ORACLES["upsert_requests"])(
    lambda s, d: stored_twice(s, d).select("group_id", "ask_row_id", "image_hash", "answer_kind", "answer_text", "confidence", "group_name"))


def appended(s, d):
    """The message lake after two batches: what was stored, and what the delta adds."""
    lake, new = EventLake(f"{shared_folder(s)}/messages-{uuid4().hex}"), delta(s, d)
    old = v.heads(s, d).filter("input_order % 5 = 0").withColumn("text", F.lit("")).select(*[c for c in new.columns])
    lake.append(old, lambda stored, rows: rows, 0)
    lake.append(new, up.ingest_messages, 1)
    return lake.read(s, new).filter(F.col(BATCH) == 1)


query("ingest_into_lake", ORACLES["ingest_messages"])(
    lambda s, d: appended(s, d).select("group_id", "row_id", F.when(F.col("text").contains("\x07"), "bell").otherwise(F.col("text")).alias("text")))
query("invalid_answers", duck("requests", "SELECT ask_row_id, 'media-missing' AS reason FROM requests WHERE answer_kind='media'"))(
    lambda s, d: up.invalid_answers(request_rows(s, d).withColumn("answer_media", F.array().cast("array<struct<hash:string>>"))).select("ask_row_id", "reason"))


def file_state(s, d):
    i = v.images(s, d).filter("file_path <> ''")
    return i.select("file_path", F.when(F.col("file_mtime") % 3 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"), "file_mtime", F.when(F.col("file_mtime") % 5 == 0, 1).otherwise(2).alias("parser_version"))


query("changed_files", duck("images", "SELECT file_path FROM images WHERE file_path<>'' AND (file_mtime%3=0 OR file_mtime%5=0)"))(
    lambda s, d: up.changed_files(v.images(s, d).filter("file_path <> ''").select("file_path", "file_size", "file_mtime"), file_state(s, d), 2).select("file_path"))
query("mark_missing", duck("images", "SELECT hash, CASE WHEN gone THEN '' ELSE file_path END AS file_path, CASE WHEN gone THEN 1 ELSE file_missing END AS file_missing FROM (SELECT *, file_path<>'' AND file_missing=0 AND file_mtime%4=0 AS gone FROM images)"))(
    lambda s, d: up.mark_missing(v.images(s, d), v.images(s, d).filter("file_mtime % 4 <> 0").select("file_path")).select("hash", "file_path", "file_missing"))
query("drop_scan_state", duck("images", "SELECT file_path, parser_version FROM (SELECT *, CASE WHEN file_mtime%5=0 THEN 1 ELSE 2 END AS parser_version FROM images WHERE file_path<>'') WHERE NOT (file_missing=0 AND file_mtime%4=0)"))(
    lambda s, d: up.drop_scan_state(file_state(s, d), up.mark_missing(v.images(s, d), v.images(s, d).filter("file_mtime % 4 <> 0").select("file_path"))).select("file_path", "parser_version"))
ORIG = "SELECT regexp_extract(path,'([a-f0-9]{32})\\.[a-z]+$',1) AS hash, min(path) AS path FROM files GROUP BY 1"


def originals(s, d):
    from colloquia.operators.media import original_index
    return original_index(files(s, d))


query("placeholders", duck("images requests", "SELECT w.hash, coalesce(o.path,'') AS file_path, 'stripped' AS generator FROM (SELECT DISTINCT hash FROM (SELECT image_hash AS hash FROM requests UNION ALL SELECT answer_hash FROM requests UNION ALL SELECT image_hash FROM requests) WHERE hash IS NOT NULL) w LEFT JOIN orig o ON o.hash=w.hash WHERE w.hash NOT IN (SELECT hash FROM images WHERE generator<>'nai')", files=FILES, orig=ORIG))(
    lambda s, d: up.placeholders(media_requests(s, d), v.images(s, d).filter("generator <> 'nai'"), originals(s, d)))
query("media_backfill", duck("images media_index", "SELECT hash, run_id, copied_path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY run_id DESC, position) AS r FROM man WHERE copied_path<>'' AND hash IN (SELECT hash FROM images WHERE object_path='' AND (file_path='' OR file_missing=1))) WHERE r=1", man=MANIFEST))(
    lambda s, d: up.media_backfill(v.images(s, d), manifest(s, d)))
query("harvest_stats", duck("images requests chat_media", """SELECT unnest(['image_refs','original_missing','parsed','stripped','skipped','attributed','requests','answered_requests','placeholders']) AS counter, unnest([(SELECT count(*) FROM r),(SELECT count(*) FROM r WHERE hash NOT IN (SELECT hash FROM orig)),
  (SELECT count(*) FROM r JOIN images i ON i.hash=r.hash WHERE i.generator<>'stripped'),(SELECT count(*) FROM r JOIN images i ON i.hash=r.hash WHERE i.generator='stripped'),0,(SELECT count(*) FROM r JOIN orig o ON o.hash=r.hash JOIN images i ON i.hash=r.hash),
  (SELECT count(*) FROM requests),(SELECT count(*) FROM requests WHERE answer_kind<>''),(SELECT count(DISTINCT h) FROM (SELECT image_hash AS h FROM requests UNION ALL SELECT answer_hash FROM requests) WHERE h IS NOT NULL AND h NOT IN (SELECT hash FROM images))]) AS value""", r="SELECT DISTINCT hash FROM chat_media WHERE kind='image'", files=FILES, orig=ORIG))(
    lambda s, d: up.harvest_stats(v.chat_media(s, d).filter("kind='image'"), originals(s, d), v.images(s, d).select("hash", F.when(F.col("generator") == "stripped", "stripped").otherwise("parsed").alias("outcome")),
                                  v.images(s, d), requests(s, d), up.placeholders(media_requests(s, d), v.images(s, d), originals(s, d))))


# ---- export ----
def ledger(s, d):
    return v.images(s, d).filter("file_mtime % 3 = 0").select("hash", F.lit(1).cast("long").alias("exportedAt"), F.lit("out").alias("outputDir"), F.lit("").alias("imageFile"), F.lit("").alias("promptFile"), F.lit("none").alias("promptSource"))


query("plan_export", duck("images", "SELECT hash FROM images WHERE file_mtime%3<>0"))(lambda s, d: ex.plan_export(v.images(s, d), ledger(s, d)).select("hash"))
query("preview_export", duck("images", "SELECT count(*) FILTER (file_mtime%3<>0) AS fresh, count(*) FILTER (file_mtime%3=0) AS already FROM images"))(lambda s, d: ex.preview_export(v.images(s, d), ledger(s, d)))
query("forget", duck("images", "SELECT hash FROM images WHERE file_mtime%3=0 AND generator<>'nai'"))(lambda s, d: ex.forget(ledger(s, d), v.images(s, d).filter("generator='nai'")).select("hash"))
_STEM = """SELECT i.*, strftime(make_timestamp(file_mtime*1000000),'%Y%m%d') || '_' || coalesce(nullif(f.sender,''), checkpoint) || '_' || substr(i.hash,1,8) AS stem, f.sender, f.group_id AS g, f.group_name AS gn, f.sent_at AS sa FROM images i LEFT JOIN (
  SELECT hash, speaker AS sender, group_id, group_name, sent_at FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY sent_at, group_id, row_id) AS r FROM named_sightings) WHERE r=1) f ON f.hash=i.hash"""
query("build_stem", duck("images named_sightings", "SELECT hash, stem FROM st", st=_STEM))(lambda s, d: ex.build_stem(v.images(s, d).join(ex.first_sighting_of(v.named_sightings(s, d)), "hash", "left")).select("hash", "stem"))
query("sanitize_stem", duck("", f"""SELECT page_id, CASE WHEN t='' THEN 'image' ELSE t END AS stem FROM (SELECT page_id, substr({trim_sql(rep(rep(rep("url", '[' + chr(92) + 'x00-' + chr(92) + 'x1F<>:"/' + chr(92) + chr(92) + '|?*]', "_"), SPACE + "+", " "), "[. ]+$", ""))},1,80) AS t FROM pages)"""))(
    lambda s, d: v.table(s, d, "pages").select("page_id", tx.sanitize_stem("url").alias("stem")))
query("dedupe_stems", duck("images", "SELECT hash, CASE WHEN n>1 THEN stem || '_' || n ELSE stem END AS stem FROM (SELECT hash, checkpoint AS stem, row_number() OVER (PARTITION BY lower(checkpoint) ORDER BY hash) AS n FROM images)"))(
    lambda s, d: ex.dedupe_stems(v.images(s, d).withColumn("stem", F.col("checkpoint")), ["hash"]).select("hash", "stem"))
_RECORDS = f"""SELECT s.hash, CASE WHEN s.file_path<>'' AND s.file_missing=0 THEN s.stem || '.png' ELSE '' END AS "imageFile", CASE WHEN e.effective_prompt<>'' THEN s.stem || '.txt' ELSE '' END AS "promptFile", s.generator, e.effective_prompt AS prompt, e.prompt_source AS "promptSource", s.negative_prompt AS "negativePrompt", s.checkpoint,
  coalesce(l.loras,'') AS loras, s.params_json AS params, s.width, s.height, s.file_mtime AS "fileMtime", coalesce(s.sender,'') AS sender, coalesce(s.gn,'') AS "groupName", coalesce(s.g,'') AS "groupId", coalesce(s.sa,0) AS "sentAt" FROM st s JOIN e ON e.hash=s.hash
  LEFT JOIN (SELECT hash, string_agg(DISTINCT lora_name, ' | ' ORDER BY lora_name) AS loras FROM image_loras GROUP BY 1) l ON l.hash=s.hash"""


def records(s, d):
    return ex.index_records(v.images(s, d), v.image_loras(s, d), v.named_sightings(s, d), requests(s, d))


EXPORT_VIEWS = "images image_loras named_sightings requests"
query("index_records", duck(EXPORT_VIEWS, _RECORDS, st=_STEM, e=_EFF))(lambda s, d: records(s, d).withColumn("loras", F.array_join("loras", " | ")))
query("csv_records", duck(EXPORT_VIEWS, f"""SELECT hash, "imageFile", "promptFile", generator, "promptSource", checkpoint, loras, CAST(width AS VARCHAR) AS width, CAST(height AS VARCHAR) AS height, sender, "groupName", CAST("sentAt" AS VARCHAR) AS "sentAt", prompt, "negativePrompt" FROM ({_RECORDS})""", st=_STEM, e=_EFF))(
    lambda s, d: ex.csv_records(records(s, d)))
query("sidecars", duck(EXPORT_VIEWS, f"""SELECT "promptFile" AS path, prompt || CASE WHEN "negativePrompt"<>'' THEN chr(10) || chr(10) || 'Negative prompt: ' || "negativePrompt" ELSE '' END || chr(10) AS content FROM ({_RECORDS}) WHERE "promptFile"<>''""", st=_STEM, e=_EFF))(
    lambda s, d: ex.sidecars(records(s, d)))
query("ledger_after", duck(EXPORT_VIEWS, f"""SELECT hash, CAST(9 AS BIGINT) AS "exportedAt", "promptSource" FROM ({_RECORDS})""", st=_STEM, e=_EFF))(
    lambda s, d: ex.ledger_after(ledger(s, d), records(s, d), 9, "o").select("hash", "exportedAt", "promptSource"))
query("stride_sample", duck("", "SELECT path FROM (SELECT path, row_number() OVER (ORDER BY path)-1 AS i, greatest((SELECT count(*) FROM files)//70,1) AS k FROM files) WHERE i%k=0 AND i//k<70", files=FILES))(
    lambda s, d: ex.stride_sample(files(s, d), ["path"], 70).select("path"))
