"""Queries over media references, media files and the ask/answer exchange."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions import asks as fa
from colloquia.functions import media as fm
from colloquia.functions import values as val
from colloquia.functions.rules import rule_table
from colloquia.operators import media as md
from colloquia.operators import pairing as pr
from colloquia.operators.ordered import positions
from colloquia.plans import views as v
from colloquia.plans.content_queries import PAGE_TEXT, SPACE, local_sql, page_text, trim_sql
from colloquia.plans.coverage_queries import _RANGE, R0, R1, _range
from colloquia.plans.registry import ORACLES, query
from colloquia.plans.views import END, START, duck

CAP = 45  # below and above the window's rows of a group at the small scales, so both outcomes occur


def raw(s, d):
    return v.heads(s, d).withColumn("msg_seq", F.col("input_order") * 2)


_SCAN = f"""SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY group_id ORDER BY input_order DESC) AS scan_rank, count(*) OVER (PARTITION BY group_id) > {CAP} AS truncated
  FROM heads h WHERE sent_at >= {R0} AND sent_at < {END} AND group_id IN (SELECT group_id FROM watchlist)) WHERE scan_rank <= {CAP}"""
query("scan_messages", duck("heads watchlist", f"SELECT group_id, row_id, scan_rank, truncated FROM ({_SCAN})"))(
    lambda s, d: md.scan_messages(raw(s, d), v.watchlist(s, d), R0, END, CAP).select("group_id", "row_id", "scan_rank", "truncated"))
query("scan_cap", duck("heads", "SELECT group_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY input_order DESC) AS r FROM heads) WHERE r<=2000"))(
    lambda s, d: md.top_per_key(raw(s, d), ["group_id"], [F.col("msg_seq").desc()], 2000).select("group_id", "row_id"))


@query("scan_outcome", duck("", f"""SELECT scan_id, CASE WHEN NOT(t OR f) THEN 'complete' WHEN f THEN 'aborted' ELSE 'scan-limit' END AS stop_reason, t AND NOT f AS scan_truncated, f AS scan_aborted,
  CAST(CASE WHEN NOT(t OR f) THEN {START} END AS BIGINT) AS covered_from FROM (SELECT o_custkey AS scan_id, bool_or(o_orderkey%11=0) AS t, bool_or(o_orderkey%17=0) AS f FROM orders GROUP BY 1)"""))
def _outcome(s, d):
    key = F.col("o_orderkey")
    rows = v.table(s, d, "orders").select(F.col("o_custkey").alias("scan_id"), (key % 25).cast("string").alias("group_id"), (key % 11 == 0).alias("truncated"), (key % 17 == 0).alias("failed"))
    return md.scan_outcome(rows, START)


query("media_refs")(lambda s, d: page_text(s, d).select("page_id", F.explode(fm.media_refs("body")).alias("r")).select("page_id", "r.*"))
query("media_text")(lambda s, d: page_text(s, d).select("page_id", fm.media_text(fm.media_refs("body"), F.col("body")).alias("m")).select("page_id", "m.*"))
query("format_refs")(lambda s, d: page_text(s, d).select("page_id", fm.format_refs(fm.media_refs("body")).alias("refs")))
query("reply_media")(lambda s, d: page_text(s, d).select("page_id", F.size(fm.reply_media(fm.media_refs("body"))).alias("kept")))
query("presentation", duck("media_index", "SELECT web_path, CASE WHEN web_path LIKE '%.mp4' THEN 'video' WHEN web_path LIKE '%.png' THEN 'image' ELSE 'file' END AS shown FROM media_index"))(
    lambda s, d: v.media_index(s, d).select("web_path", fm.presentation("web_path").alias("shown")))


def refs(s, d):
    return v.chat_media(s, d).withColumn("row_num", F.col("row_id").try_cast("decimal(38,0)"))


_OWNED = """SELECT *, kind='emoji' OR hash IS NULL OR row_number() OVER (PARTITION BY group_id, hash, kind='emoji' ORDER BY sent_at, CAST(row_id AS BIGINT))=1 AS owned FROM chat_media"""
query("owned_refs", duck("chat_media", "SELECT group_id, row_id, hash, owned FROM o", o=_OWNED))(lambda s, d: md.owned_refs(refs(s, d)).select("group_id", "row_id", "hash", "owned"))
query("quote_links", duck("chat_media", "SELECT DISTINCT group_id, row_id, hash AS quoted_hash FROM o WHERE NOT owned AND kind='image'", o=_OWNED))(lambda s, d: md.quote_links(md.owned_refs(refs(s, d))))
query("first_sighting", duck("chat_media", "SELECT hash, group_id, row_id, sent_at, speaker, sender FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY sent_at, input_order) AS r FROM chat_media WHERE kind='image') WHERE r=1"))(
    lambda s, d: md.first_sighting(refs(s, d)))
_OWNERS = "SELECT hash, group_id, row_id, sent_at, sender, speaker, input_order FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY sent_at, input_order) AS r FROM chat_media WHERE kind='image') WHERE r=1"
query("image_owners", duck("chat_media", _OWNERS))(lambda s, d: md.image_owners(refs(s, d)))

# ---- gallery ----
FLAGGED = "SELECT *, row_number() OVER (PARTITION BY group_id, content_key ORDER BY sent_at DESC, input_order)>1 AS dup FROM media_index"
query("flag_duplicates", duck("media_index", "SELECT web_path, dup FROM f", f=FLAGGED))(lambda s, d: md.flag_duplicates(v.media_index(s, d)).select("web_path", "dup"))
_EV = """SELECT *, min(sent_at) OVER (PARTITION BY group_id, blk) AS event_start FROM (SELECT *, sum(CASE WHEN p IS NULL OR sent_at-p>1200 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY sent_at, input_order ROWS UNBOUNDED PRECEDING) AS blk FROM (
  SELECT *, lag(sent_at) OVER (PARTITION BY group_id ORDER BY sent_at, input_order) AS p FROM media_index))"""
EVENTS = """SELECT 'event:' || group_id || ':' || arg_min(row_id, input_order) || ':' || event_start AS event_id, group_id, event_start AS start_unix, max(sent_at) AS end_unix, count(*) AS item_count,
  count(*) FILTER (kind='image') AS image_count, count(*) FILTER (kind='video') AS video_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(DISTINCT speaker) AS speaker_count FROM ev GROUP BY group_id, event_start"""
query("media_events", duck("media_index", EVENTS, ev=_EV))(lambda s, d: md.media_events(v.media_index(s, d)))
query("event_speakers", duck("media_index", "SELECT DISTINCT group_id, event_start AS start_unix, speaker FROM ev", ev=_EV))(lambda s, d: md.event_speakers(v.media_index(s, d)))
query("events_for_matches", duck("media_index", f"SELECT * FROM ({EVENTS}) WHERE (group_id, start_unix) IN (SELECT (group_id, event_start) FROM ev WHERE kind='video')", ev=_EV))(
    lambda s, d: md.events_for_matches(v.media_index(s, d), v.media_index(s, d).filter("kind='video'")))
_CHAIN = "SELECT content_key, count(*) AS occurrences, count(DISTINCT group_id) AS group_count, count(DISTINCT speaker) AS speaker_count, min(sent_at) AS first_unix, max(sent_at) AS last_unix FROM media_index GROUP BY 1 HAVING count(*)>1"
query("propagation", duck("media_index", _CHAIN))(lambda s, d: md.propagation(v.media_index(s, d)))
query("chain_occurrences", duck("media_index", "SELECT content_key, sent_at, group_id, web_path, row_number() OVER (PARTITION BY content_key ORDER BY sent_at, group_id, web_path) AS position FROM media_index WHERE content_key IN (SELECT content_key FROM c)", c=_CHAIN))(
    lambda s, d: md.chain_occurrences(v.media_index(s, d)))
_FILTER = f"group_id='1009' AND kind='image' AND contains(lower(speaker),'user-') AND sent_at>={R0} AND sent_at<{END}"
query("media_filter_primary", duck("media_index", f"SELECT web_path FROM f WHERE NOT dup AND {_FILTER}", f=FLAGGED))(
    lambda s, d: md.media_filter(md.flag_duplicates(v.media_index(s, d)), "1009", "image", "USER-", R0, END).select("web_path"))
query("media_filter_all", duck("media_index", f"SELECT web_path FROM f WHERE {_FILTER}", f=FLAGGED))(
    lambda s, d: md.media_filter(md.flag_duplicates(v.media_index(s, d)), "1009", "image", "USER-", R0, END, False).select("web_path"))
for _mode, _order in {"time-desc": "sent_at DESC", "time-asc": "sent_at", "size-desc": "bytes DESC, sent_at DESC"}.items():
    query(f"media_sort_{_mode.replace('-', '_')}", duck("media_index", f"SELECT web_path, bytes, row_number() OVER (ORDER BY {_order}, input_order) AS position FROM media_index"))(
        lambda s, d, m=_mode: positions(md.media_sort(v.media_index(s, d), m)).select("web_path", "bytes", "position"))
query("media_summary", duck("media_index", "SELECT count(*) AS item_count, count(DISTINCT group_id) AS group_count, count(DISTINCT speaker) AS speaker_count, min(sent_at) AS first_unix, max(sent_at) AS last_unix, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM media_index"))(
    lambda s, d: md.media_summary(v.media_index(s, d)))
query("media_by_day", duck("media_index", f"SELECT substr({local_sql('sent_at')},1,10) AS day, count(*) AS item_count, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM media_index GROUP BY 1"))(lambda s, d: md.by_day(v.media_index(s, d)))


def partial_index(s, d):
    """Index in which every third file lost its row id, as older manifests have it."""
    return v.media_index(s, d).withColumn("row_id", F.when(F.col("input_order") % 3 == 0, "").otherwise(F.col("row_id")))


query("message_media", duck("heads media_index", """SELECT m.group_id, m.row_id AS message_row, f.web_path, 'row' AS via FROM heads m JOIN fi f ON f.group_id=m.group_id AND f.row_id=substr(m.row_id,2) WHERE m.is_media=1
  UNION ALL SELECT w.group_id, w.row_id, coalesce(a.web_path, b.web_path), 'time' FROM (SELECT *, row_number() OVER (PARTITION BY group_id, sent_at ORDER BY row_id) AS n FROM heads m WHERE is_media=1 AND NOT EXISTS (SELECT 1 FROM fi f WHERE f.group_id=m.group_id AND f.row_id=substr(m.row_id,2))) w
  LEFT JOIN ff a ON a.group_id=w.group_id AND a.sent_at=w.sent_at AND a.n=w.n JOIN ff b ON b.group_id=w.group_id AND b.sent_at=w.sent_at AND b.n=1""",
                            fi="SELECT * REPLACE (CASE WHEN input_order%3=0 THEN '' ELSE row_id END AS row_id) FROM media_index", ff="SELECT *, row_number() OVER (PARTITION BY group_id, sent_at ORDER BY input_order) AS n FROM media_index"))(
    lambda s, d: md.message_media(v.heads(s, d), partial_index(s, d)))
query("media_names", duck("media_index group_names", f"""SELECT run_id, run_index, lpad(CAST(run_index AS VARCHAR),CAST(greatest(4,length(CAST(run_index AS VARCHAR))) AS INTEGER),'0') || '_' || regexp_replace({local_sql('sent_at')},'[-: ]','','g') || '_' || substr(regexp_replace(coalesce(nullif(n.name,''),m.group_id),'[^A-Za-z0-9_.-]+','_','g'),1,120)
  || '_' || speaker || regexp_extract(web_path,'(\\.[^.]+)$',1) AS target_name FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sent_at, input_order) AS run_index FROM media_index) m LEFT JOIN group_names n ON n.group_id=m.group_id"""))(
    lambda s, d: md.media_names(v.media_index(s, d).withColumnRenamed("web_path", "file_name"), v.group_names(s, d)))


def files(s, d):
    """Two cached files per part: the original and its thumbnail."""
    key = F.md5(F.col("p_partkey").cast("string"))
    base = v.table(s, d, "part")
    return base.select(F.concat(F.lit("Pic/2024-01/Ori/"), key, F.lit(".png")).alias("path"), (F.col("p_size").cast("long") * 1000).alias("size")).unionByName(
        base.select(F.concat(F.lit("Pic/2024-01/Thumb/"), key, F.lit(".jpg")).alias("path"), (F.col("p_size").cast("long") * 1010).alias("size")))


FILES = "SELECT 'Pic/2024-01/Ori/' || md5(CAST(p_partkey AS VARCHAR)) || '.png' AS path, CAST(p_size AS BIGINT)*1000 AS size FROM part UNION ALL SELECT 'Pic/2024-01/Thumb/' || md5(CAST(p_partkey AS VARCHAR)) || '.jpg', CAST(p_size AS BIGINT)*1010 FROM part"


def source_refs(s, d):
    eid = F.col("input_order")
    return v.chat_media(s, d).select("row_id", F.when(eid % 5 == 0, F.concat(F.lit("Pic/2024-01/Thumb/"), "hash", F.lit(".jpg"))).alias("local_path"),
                                     F.when(eid % 3 == 0, F.lit(None)).otherwise(F.upper("hash")).alias("hash"), F.upper("file_name").alias("file_name"))


query("resolve_sources", duck("chat_media", """SELECT c.row_id, coalesce(p.path, h.path, n.path) AS source_path, CASE WHEN p.path IS NOT NULL THEN 'path' WHEN h.path IS NOT NULL THEN 'hash' WHEN n.path IS NOT NULL THEN 'name' ELSE 'none' END AS via FROM chat_media c
  LEFT JOIN files p ON c.input_order%5=0 AND p.path = 'Pic/2024-01/Thumb/' || c.hash || '.jpg' LEFT JOIN (SELECT regexp_extract(path,'[a-f0-9]{32}') AS hash, arg_max(path, CASE WHEN path LIKE '%.png' THEN 1 ELSE 0 END) AS path FROM files GROUP BY 1) h ON c.input_order%3<>0 AND h.hash=c.hash
  LEFT JOIN files n ON n.path = 'Pic/2024-01/Ori/' || c.file_name""", files=FILES))(
    lambda s, d: md.resolve_sources(source_refs(s, d), files(s, d), ["png"]).select("row_id", "source_path", "via"))
query("original_index", duck("", "SELECT regexp_extract(path,'([a-f0-9]{32})\\.[a-z]+$',1) AS hash, min(path) AS path FROM files GROUP BY 1", files=FILES))(lambda s, d: md.original_index(files(s, d)))


def review_rows(s, d):
    """Review notes: one per order, some with an unknown status or no note."""
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in [*fv.REVIEW_STATUSES, "odd"]]), (key % 4 + 1).cast("int"))
    return v.table(s, d, "orders").select((key % 997).cast("string").alias("event_id"), key.alias("seq"), status.alias("status"), (key % 5 == 0).alias("favorite"),
                                          F.when(key % 13 != 0, F.concat(F.lit("  note "), key.cast("string"))).alias("note"))


query("normalize_review", duck("", """SELECT event_id, seq, status, favorite, note FROM (SELECT CAST(o_orderkey%997 AS VARCHAR) AS event_id, o_orderkey AS seq, CASE o_orderkey%4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'follow-up' ELSE 'odd' END AS status,
  o_orderkey%5=0 AS favorite, CASE WHEN o_orderkey%13<>0 THEN 'note ' || o_orderkey END AS note FROM orders) WHERE status<>'odd' AND note IS NOT NULL"""))(lambda s, d: md.normalize_review(review_rows(s, d))[0])
_REVIEWS = """SELECT event_id, arg_max(status, seq) AS status, arg_max(favorite, seq) AS favorite, arg_max(note, seq) AS note FROM (SELECT CAST(o_orderkey%997 AS VARCHAR) AS event_id, o_orderkey AS seq, CASE o_orderkey%4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'follow-up' ELSE 'odd' END AS status,
  o_orderkey%5=0 AS favorite, CASE WHEN o_orderkey%13<>0 THEN 'note ' || o_orderkey END AS note FROM orders) WHERE status<>'odd' AND note IS NOT NULL GROUP BY 1"""


def reviews(s, d):
    good = md.normalize_review(review_rows(s, d))[0]
    return md.upsert_reviews(good.limit(0), good)


query("upsert_reviews", duck("", _REVIEWS))(reviews)
_SMALL_EVENTS = "SELECT CAST(c_custkey AS VARCHAR) AS event_id FROM customer"
for _mode in ["unreviewed", "reviewed", "follow-up", "favorite"]:
    _cond = "favorite" if _mode == "favorite" else f"coalesce(status,'unreviewed')='{_mode}'"
    query(f"review_filter_{_mode.replace('-', '_')}", duck("", f"SELECT e.event_id FROM ({_SMALL_EVENTS}) e LEFT JOIN r ON r.event_id=e.event_id WHERE {_cond}", r=_REVIEWS))(
        lambda s, d, m=_mode: md.review_filter(v.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("event_id")), reviews(s, d), m))
query("manifest_lines", duck("media_index", f"SELECT row_id, '[' || {local_sql('sent_at')} || '] ' || speaker || ' ' || kind || ': ' || web_path AS line FROM media_index"))(
    lambda s, d: md.manifest_lines(v.media_index(s, d).withColumn("copied_path", F.lit("")).withColumn("url", F.col("web_path"))))
query("empty_state", duck("", "SELECT group_id, CASE WHEN coverage_ratio<=0 THEN 'unscanned' WHEN coverage_ratio<0.999 THEN 'partial' WHEN message_count=0 THEN 'no-messages' WHEN media_count>0 THEN 'media-unavailable' ELSE 'no-media' END AS state FROM r", r="SELECT o_orderkey AS group_id, (o_orderkey%4)/3.0 AS coverage_ratio, o_custkey%3 AS message_count, (o_orderkey//4)%2 AS media_count FROM orders"))(
    lambda s, d: v.table(s, d, "orders").select(F.col("o_orderkey").alias("group_id"), (F.col("o_orderkey") % 4 / 3.0).alias("coverage_ratio"), (F.col("o_custkey") % 3).alias("message_count"), F.expr("(o_orderkey div 4) % 2").alias("media_count")).select("group_id", val.empty_state(F.col("coverage_ratio"), F.col("message_count"), F.col("media_count")).alias("state")))

# ---- ask / answer ----
_MARKERS = fv.PARAMETER_MARKERS
# DuckDB has no look-around; here each one stands for a word border
_VOCAB = [re.sub(r"\(\?(?:<!|!|=)\[A-Za-z0-9_\]\)", r"\\b", p) for p in fv.PROMPT_VOCABULARY]
_HITS = " + ".join(f"CAST(regexp_matches(t,'{p}') AS INT)" for p in _VOCAB)
SHAPED = f"""SELECT *, length(t)>=24 AND (regexp_matches(t,'{_MARKERS}') OR (NOT (regexp_matches(t,'[。！？!?；]') AND length(regexp_replace(t,'[^\\p{{Han}}]','','g'))/CAST(greatest(length(t),1) AS DOUBLE)>0.3)
  AND {_HITS} >= 2 AND len(seg)>=4 AND len(list_filter(seg, lambda x: length(x)<=40))>=4)) AS is_prompt FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(t,'[,，\\n]'), lambda x: {trim_sql('x')}), lambda x: x<>'') AS seg FROM (
  SELECT *, {trim_sql('text')} AS t FROM chat_text))"""
query("looks_like_prompt", duck("chat_text", f"SELECT row_id, is_prompt FROM ({SHAPED})"))(lambda s, d: v.chat_text(s, d).select("row_id", fa.looks_like_prompt("text").alias("is_prompt")))
ASKS = """SELECT c.*, q.quoted_hash, CASE WHEN text='kkt' THEN 'prompt' WHEN text='kko 谢谢' THEN 'original' WHEN text='求tag' THEN 'prompt' WHEN text='原图呢？' THEN 'original' WHEN text='发我原图' AND q.quoted_hash IS NOT NULL THEN 'original' END AS intent,
  CASE WHEN text='kkt' THEN 'kk:t' WHEN text='kko 谢谢' THEN 'kk:o' WHEN text='发我原图' THEN 'contextual' ELSE 'exact' END AS rule FROM chat_text c LEFT JOIN quote_links q ON q.group_id=c.group_id AND q.row_id=c.row_id
  WHERE text IN ('kkt','kko 谢谢','求tag','原图呢？') OR (text='发我原图' AND q.quoted_hash IS NOT NULL)"""
query("find_asks", duck("chat_text quote_links", f"SELECT group_id, row_id, intent, rule, quoted_hash, text AS ask_text FROM ({ASKS})"))(
    lambda s, d: pr.find_asks(v.chat_text(s, d), v.quote_links(s, d)).select("group_id", "row_id", "intent", "rule", "quoted_hash", "ask_text"))
query("find_asks_by_rules", duck("chat_text quote_links", f"SELECT group_id, row_id, intent, rule, quoted_hash, text AS ask_text FROM ({ASKS})"))(
    lambda s, d: pr.find_asks(v.chat_text(s, d), v.quote_links(s, d), rule_table(s)).select("group_id", "row_id", "intent", "rule", "quoted_hash", "ask_text"))
query("classify_ask", duck("chat_text quote_links", f"SELECT rule, intent, count(*) AS n FROM ({ASKS}) GROUP BY 1,2"))(
    lambda s, d: pr.find_asks(v.chat_text(s, d), v.quote_links(s, d)).groupBy("rule", "intent").agg(F.count(F.lit(1)).alias("n")))


def answer_sql(intent, source, window):
    return f"""SELECT * FROM (SELECT a.row_id, a.group_id, a.sent_at, c.sent_at AS answer_at, c.sender AS answer_sender, c.speaker AS answer_by, {'c.t' if intent == 'prompt' else "''"} AS answer_text, {'c.hash' if intent == 'original' else 'NULL'} AS answer_hash,
      row_number() OVER (PARTITION BY a.group_id, a.row_id ORDER BY c.sent_at, c.input_order) AS r FROM asks a JOIN {source} c ON c.group_id=a.group_id AND c.sent_at>=a.sent_at AND c.sent_at-a.sent_at<={window} AND c.sender<>a.sender WHERE a.intent='{intent}') WHERE r=1"""


ANSWERS = dict(asks=ASKS, shaped=f"SELECT * FROM ({SHAPED}) WHERE is_prompt", pics="SELECT * FROM chat_media WHERE kind IN ('image','file')",
               ans=answer_sql("prompt", "shaped", 1800) + " UNION ALL " + answer_sql("original", "pics", 120), owners=_OWNERS)
CHAT = "chat_text quote_links chat_media"
query("first_answer", duck(CHAT, "SELECT DISTINCT a.group_id, a.sent_at, a.sender, x.answer_at, x.answer_sender, x.answer_text FROM asks a LEFT JOIN ans x ON x.group_id=a.group_id AND x.row_id=a.row_id WHERE a.intent='prompt'", **ANSWERS))(
    lambda s, d: pr.first_answer(pr.find_asks(v.chat_text(s, d), v.quote_links(s, d)).filter("intent='prompt'"), v.chat_text(s, d)).select("group_id", "sent_at", "sender", "answer_at", "answer_sender", F.col("payload.text").alias("answer_text")))
query("first_media_answer", duck(CHAT, "SELECT DISTINCT a.group_id, a.sent_at, a.sender, x.answer_at, x.answer_sender, x.answer_hash FROM asks a LEFT JOIN ans x ON x.group_id=a.group_id AND x.row_id=a.row_id WHERE a.intent='original'", **ANSWERS))(
    lambda s, d: pr.first_media_answer(pr.find_asks(v.chat_text(s, d), v.quote_links(s, d)).filter("intent='original'"), v.chat_media(s, d)).select("group_id", "sent_at", "sender", "answer_at", "answer_sender", F.get("payload.media", F.lit(0))["hash"].alias("answer_hash")))
PAIRS = """SELECT *, CASE WHEN against THEN NULL ELSE th END AS image_hash, CASE WHEN against OR th IS NULL THEN '' ELSE tsp END AS image_owner, CAST(CASE WHEN against OR th IS NULL THEN 0 ELSE tat END AS BIGINT) AS image_sent_at,
  CASE WHEN against THEN 'guess-contradicted' ELSE coalesce(via,'none') END AS target_via, CASE WHEN against OR via IS NULL THEN 'none' ELSE level END AS confidence FROM (SELECT *, intent='prompt' AND answer_at IS NOT NULL AND coalesce(level='low' AND tse<>'' AND tse<>answer_sender, false) AS against FROM (
  SELECT b.*, CASE WHEN quoted_hash IS NOT NULL THEN quoted_hash WHEN intent='prompt' AND ac>=1 THEN ah WHEN nc=1 THEN nh END AS th,
  CASE WHEN quoted_hash IS NOT NULL THEN coalesce(qsp,'') WHEN intent='prompt' AND ac>=1 THEN asp WHEN nc=1 THEN nsp END AS tsp, CASE WHEN quoted_hash IS NOT NULL THEN coalesce(qat,0) WHEN intent='prompt' AND ac>=1 THEN aat WHEN nc=1 THEN nat END AS tat,
  CASE WHEN quoted_hash IS NOT NULL THEN coalesce(qse,'') WHEN intent='prompt' AND ac>=1 THEN ase WHEN nc=1 THEN nse END AS tse,
  CASE WHEN qse IS NOT NULL THEN 'quote' WHEN quoted_hash IS NOT NULL THEN 'quote-unresolved' WHEN intent='prompt' AND ac=1 THEN 'answer-author' WHEN intent='prompt' AND ac>1 THEN 'answer-author-multiple' WHEN nc=1 THEN 'recent-unambiguous' END AS via,
  CASE WHEN qse IS NOT NULL THEN 'high' WHEN quoted_hash IS NOT NULL THEN 'medium' WHEN intent='prompt' AND ac=1 THEN 'medium' ELSE 'low' END AS level FROM (
   SELECT a.group_id, a.row_id, a.sent_at, a.sender, a.speaker, a.text, a.intent, a.rule, a.quoted_hash, x.answer_at, x.answer_sender, x.answer_by, x.answer_text, x.answer_hash, q.speaker AS qsp, q.sent_at AS qat, q.sender AS qse,
   count(o.hash) FILTER (o.sender=x.answer_sender) AS ac, arg_max(o.hash, (o.sent_at, -o.input_order)) FILTER (o.sender=x.answer_sender) AS ah, arg_max(o.speaker, (o.sent_at, -o.input_order)) FILTER (o.sender=x.answer_sender) AS asp, max(o.sent_at) FILTER (o.sender=x.answer_sender) AS aat, arg_max(o.sender,(o.sent_at,-o.input_order)) FILTER (o.sender=x.answer_sender) AS ase,
   count(o.hash) FILTER (a.sent_at-o.sent_at<=120) AS nc, arg_max(o.hash,(o.sent_at,-o.input_order)) FILTER (a.sent_at-o.sent_at<=120) AS nh, arg_max(o.speaker,(o.sent_at,-o.input_order)) FILTER (a.sent_at-o.sent_at<=120) AS nsp, max(o.sent_at) FILTER (a.sent_at-o.sent_at<=120) AS nat, arg_max(o.sender,(o.sent_at,-o.input_order)) FILTER (a.sent_at-o.sent_at<=120) AS nse
   FROM asks a LEFT JOIN ans x ON x.group_id=a.group_id AND x.row_id=a.row_id LEFT JOIN owners q ON q.hash=a.quoted_hash LEFT JOIN owners o ON o.group_id=a.group_id AND o.sent_at<=a.sent_at AND a.sent_at-o.sent_at<=1800 GROUP BY ALL) b))"""
query("pair_requests", duck(CHAT, """SELECT group_id, row_id AS ask_row_id, sent_at AS ask_sent_at, speaker AS asker, text AS ask_text, intent, rule, image_hash, image_owner, image_sent_at, target_via, confidence,
  CASE WHEN answer_at IS NULL THEN '' WHEN intent='original' THEN 'media' ELSE 'text' END AS answer_kind, coalesce(answer_text,'') AS answer_text, coalesce(answer_hash,'') AS answer_media, coalesce(answer_by,'') AS answer_by, coalesce(answer_at,0) AS answer_sent_at FROM pairs""", **ANSWERS, pairs=PAIRS))(
    lambda s, d: pr.pair_requests(v.chat_text(s, d), v.chat_media(s, d), v.quote_links(s, d)).withColumn("answer_media", F.array_join(F.transform("answer_media", lambda m: m["hash"]), ",")))
query("target_via", duck(CHAT, "SELECT target_via, confidence, count(*) AS n FROM pairs GROUP BY 1,2", **ANSWERS, pairs=PAIRS))(
    lambda s, d: pr.pair_requests(v.chat_text(s, d), v.chat_media(s, d), v.quote_links(s, d)).groupBy("target_via", "confidence").agg(F.count(F.lit(1)).alias("n")))


# ---- the same exchange sixty times as fast: asks now have images and answers near them, so every way to find a target occurs ----
def _busy_sql(sql):
    for ts in ("epoch_us(e.ts)//1000000", "epoch_us(ts)//1000000"):
        sql = sql.replace(ts, f"{START}+({ts[:-9]}//1000000-{START})//60")
    return sql


def _busy(df):
    return df.withColumn("sent_at", F.expr(f"{START} + (sent_at - {START}) div 60"))


def _busy_pairs(s, d):
    return pr.pair_requests(_busy(v.chat_text(s, d)), _busy(v.chat_media(s, d)), v.quote_links(s, d))


query("pair_requests_busy", _busy_sql(ORACLES["pair_requests"]))(lambda s, d: _busy_pairs(s, d).withColumn("answer_media", F.array_join(F.transform("answer_media", lambda m: m["hash"]), ",")))
query("target_via_busy", _busy_sql(ORACLES["target_via"]))(lambda s, d: _busy_pairs(s, d).groupBy("target_via", "confidence").agg(F.count(F.lit(1)).alias("n")))
query("withdrawn_busy", duck("", "SELECT ask_row_id FROM p WHERE target_via='guess-contradicted'", p=_busy_sql(ORACLES["pair_requests"])))(lambda s, d: pr.withdrawn(_busy_pairs(s, d)).select("ask_row_id"))
