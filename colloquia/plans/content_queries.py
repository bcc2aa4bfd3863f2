"""Queries over message texts: cleaning, keywords, blocks, signals, topics, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions import text as tx
from colloquia.functions import values as val
from colloquia.operators import chunks as ch
from colloquia.operators import content as ct
from colloquia.operators import topics as tp
from colloquia.plans import views as v
from colloquia.plans.registry import query
from colloquia.plans.views import duck
from colloquia.session import durable

SPACE = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
STOP = ",".join(f"'{w}'" for w in fv.STOP_WORDS)


def trim_sql(x):
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def rep(x, pattern, to):
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def local_sql(x):
    return f"strftime(make_timestamp(({x}+28800)*1000000), '%Y-%m-%d %H:%M:%S')"


LABEL = "coalesce(nullif(n.name,''), m.group_id)"
TOKENS = rf"""list_filter(list_transform(list_concat(regexp_extract_all(text,'(\p{{Han}}{{2,8}})'), regexp_extract_all(text,'([a-zA-Z][a-zA-Z0-9_-]{{2,}}|[0-9]{{3,}})')), lambda t: lower(t)),
  lambda t: length(t) BETWEEN 2 AND 24 AND NOT list_contains([{STOP}], t))"""
STATS = f"""SELECT group_id, token, count(*) AS count, count(DISTINCT row_id) AS messages FROM (SELECT group_id, row_id, unnest({TOKENS}) AS token FROM messages) GROUP BY 1,2
  HAVING count(DISTINCT row_id)>=2 OR count(*)>=3"""
IMPORTANT = f"""SELECT group_id, token, token_rank FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY messages DESC, count DESC, token) AS token_rank FROM ({STATS})) WHERE token_rank<=80"""


def docs(s, d):
    return v.texts(s, d, "documents", "doc_id")


query("speaker", duck("", "SELECT n_nationkey, coalesce(nullif(CASE WHEN n_regionkey=0 THEN '' ELSE n_name END,''), nullif(CASE WHEN n_nationkey%2=0 THEN '' ELSE 'card' END,''), 'Unknown') AS speaker FROM nation"))(
    lambda s, d: v.table(s, d, "nation").select("n_nationkey", tx.speaker(F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_name")), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("card")).alias("speaker")))
query("light_clean", duck("", f"""SELECT doc_id, {trim_sql(rep(rep("text", r"[\x{FFFD}\x00-\x08\x0B-\x1F\x7F]", ""), " {2,}", " "))} AS cleaned FROM documents"""))(
    lambda s, d: docs(s, d).select("doc_id", tx.light_clean("text").alias("cleaned")))
query("report_clean", duck("", f"""SELECT doc_id, {trim_sql("regexp_replace(" + rep(rep("text", r"\x00", ""), r"[ \t]+\n", r"\n").replace("'\\n'", "chr(10)") + r", '\n{3,}', chr(10)||chr(10), 'g')")} AS cleaned FROM documents"""))(
    lambda s, d: docs(s, d).select("doc_id", tx.report_clean("text").alias("cleaned")))
query("clean_extracted", duck("", f"""SELECT doc_id, {trim_sql(rep("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]", ""))} AS cleaned FROM documents"""))(
    lambda s, d: docs(s, d).select("doc_id", tx.clean_extracted("text").alias("cleaned")))
query("to_local", duck("heads", f"SELECT row_id, {local_sql('sent_at')} AS local_time, substr({local_sql('sent_at')},1,10) AS local_day FROM heads"))(
    lambda s, d: v.heads(s, d).select("row_id", val.to_local("sent_at").alias("local_time"), val.local_day("sent_at").alias("local_day")))
query("from_local", duck("heads", "SELECT row_id, CASE WHEN sent_at%5=0 THEN NULL ELSE sent_at END AS sent_at FROM heads"))(
    lambda s, d: v.heads(s, d).select("row_id", val.from_local(F.when(F.col("sent_at") % 5 == 0, F.concat(F.lit("x"), val.to_local("sent_at"))).otherwise(val.to_local("sent_at"))).alias("sent_at")))
query("message_line", duck("messages group_names", f"SELECT m.group_id, m.row_id, m.sent_at, substr({local_sql('m.sent_at')},1,10) AS day, '[' || {local_sql('m.sent_at')} || '] [' || {LABEL} || '] ' || m.speaker || ': ' || m.text AS line FROM messages m LEFT JOIN group_names n ON n.group_id=m.group_id"))(
    lambda s, d: ct.lines(v.messages(s, d), v.group_names(s, d)))


def page_text(s, d):
    """Every page as one message body with its link and cached-file mentions."""
    key = F.col("page_id").cast("string")
    body = F.concat(F.col("html"), F.lit(" "), F.col("url"), F.lit("/a.png?x=1 D:\\chat\\Emoji\\"), F.md5(key), F.lit(".gif "), F.md5(F.col("url")), F.lit(".mp4 (see "), F.col("url"), F.lit(")"))
    return v.texts(s, d, "pages", "page_id").select("page_id", body.alias("body"))


PAGE_TEXT = r"SELECT page_id, html || ' ' || url || '/a.png?x=1 D:\chat\Emoji\' || md5(CAST(page_id AS VARCHAR)) || '.gif ' || md5(url) || '.mp4 (see ' || url || ')' AS body FROM pages"
query("extract_urls", duck("", r"""SELECT page_id, unnest(u) AS url, unnest(range(len(u))) AS position FROM (SELECT page_id, regexp_extract_all(body, '(https?://[^\s<>"''）)]+)') AS u FROM p)""", p=PAGE_TEXT))(
    lambda s, d: page_text(s, d).select("page_id", F.posexplode(tx.extract_urls("body")).alias("position", "url")).withColumn("position", F.col("position").cast("long")))
query("body_snippet", duck("", f"""SELECT doc_id, substr({trim_sql(rep(rep("text", r"[^\p{L}\p{N}\p{P}\p{S}\s._:/\\-]+", " "), SPACE + "+", " "))},1,220) AS snippet FROM documents"""))(
    lambda s, d: docs(s, d).select("doc_id", tx.body_snippet("text").alias("snippet")))
query("likely_tokens", duck("", r"""SELECT page_id, array_to_string(list_slice(list_filter(u, lambda x, i: list_position(u, x) = i),1,12),'|') AS tokens FROM (SELECT page_id,
  regexp_extract_all(body, '([a-fA-F0-9]{32}|[A-Za-z]:\\[^\x00-\x1f"''<>|]+|[A-Za-z0-9_.-]+\.(?:jpg|jpeg|png|gif|webp|mp4|mov|avi|mkv))') AS u FROM p)""", p=PAGE_TEXT))(
    lambda s, d: page_text(s, d).select("page_id", F.array_join(tx.likely_tokens("body"), "|").alias("tokens")))
query("sanitize_snippet", duck("", r"""SELECT doc_id, CASE WHEN length(t)>=4 THEN t ELSE '' END AS snippet FROM (SELECT doc_id, substr(trim(array_to_string(list_filter(
  regexp_extract_all(regexp_replace(text,'[\x{FFFD}\x00-\x1F\x7F-\x{A0}]',' ','g'),'([\x{4E00}-\x{9FFF}]{2,}[，。！？、：；]?|[A-Za-z][A-Za-z''-]{2,}|[0-9]{2,})'),
  lambda w: NOT regexp_matches(w,'^[A-Za-z''-]+$') OR (length(w)<=14 AND regexp_matches(w,'(?i)[aeiou]') AND len(regexp_extract_all(w,'[A-Z]+|[^A-Z]+'))-1<=2)),' ')),1,120) AS t FROM documents)"""))(
    lambda s, d: docs(s, d).select("doc_id", tx.sanitize_snippet("text").alias("snippet")))
query("merge_key", duck("", f"""SELECT doc_id, lower({trim_sql(rep("text", SPACE + "+", " "))}) AS key FROM documents"""))(
    lambda s, d: docs(s, d).select("doc_id", tx.merge_key("text").alias("key")))
query("safe_name", duck("", "SELECT page_id, substr(regexp_replace(url,'[^A-Za-z0-9_.-]+','_','g'),1,120) AS safe FROM pages"))(
    lambda s, d: v.table(s, d, "pages").select("page_id", tx.safe_name("url").alias("safe")))
query("normalize_path", duck("", rf"""SELECT page_id, {trim_sql(rep("replace(url,'/','" + chr(92) + "')", r"[^\p{L}\p{N}\p{P}\p{S}\s._:\\-]+", ""))} AS path FROM pages"""))(
    lambda s, d: v.table(s, d, "pages").select("page_id", tx.normalize_path("url").alias("path")))
query("message_tokens", duck("", f"SELECT doc_id, array_to_string({TOKENS},' ') AS tokens FROM documents"))(
    lambda s, d: docs(s, d).select("doc_id", F.array_join(tx.tokens("text"), " ").alias("tokens")))

for _key, _cols in {"speaker": "heads", "group_id": "heads", "local_day": "heads"}.items():
    _expr = f"substr({local_sql('sent_at')},1,10)" if _key == "local_day" else _key
    query(f"count_by_{_key}", duck("heads", f"SELECT {_expr} AS {_key}, count(*) AS count FROM heads GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))(
        lambda s, d, k=_key: ct.count_by(v.heads(s, d).withColumn("local_day", val.local_day("sent_at")), k, 20))
query("count_by_media_kind", duck("chat_media", "SELECT kind, count(*) AS count FROM chat_media GROUP BY 1"))(lambda s, d: ct.count_by(v.chat_media(s, d), "kind"))
query("token_stats", duck("messages", STATS))(lambda s, d: ct.token_stats(v.tokened(s, d)))
query("keyword_ranking", duck("messages", f"SELECT group_id, token, messages, count, token_rank FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY messages DESC, count DESC, token) AS token_rank FROM ({STATS})) WHERE token_rank<=30"))(
    lambda s, d: ct.top_tokens(v.tokened(s, d), 30))


def blocks_sql(keys, gap=1800):
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    on = " AND a.group_id=b.group_id" if keys else ""
    return f"""SELECT {('a.' + lead) if keys else ''}a.start_unix, a.end_unix, a.message_count, b.top_speakers FROM (SELECT {lead}blk, min(sent_at) AS start_unix, max(sent_at) AS end_unix, count(*) AS message_count FROM blk GROUP BY ALL) a JOIN (
      SELECT {lead}blk, string_agg(speaker || ':' || n, ',' ORDER BY n DESC, speaker) AS top_speakers FROM (SELECT *, row_number() OVER (PARTITION BY {lead}blk ORDER BY n DESC, speaker) AS r FROM (SELECT {lead}blk, speaker, count(*) AS n FROM blk GROUP BY ALL)) WHERE r<=5 GROUP BY ALL) b ON a.blk=b.blk{on}""", f"""
      SELECT *, sum(CASE WHEN p IS NULL OR sent_at-p>{gap} THEN 1 ELSE 0 END) OVER ({part}ORDER BY sent_at, input_order ROWS UNBOUNDED PRECEDING) AS blk FROM (SELECT *, lag(sent_at) OVER ({part}ORDER BY sent_at, input_order) AS p FROM heads)"""


_body, _blk = blocks_sql("group_id")
query("time_blocks", duck("heads", _body, blk=_blk))(lambda s, d: ct.time_blocks(v.heads(s, d)))
_body, _blk = blocks_sql("")
query("time_blocks_combined", duck("heads", _body.replace("1800", "600"), blk=_blk.replace(">1800", ">120")))(lambda s, d: ct.time_blocks(v.heads(s, d), [], gap=120))
_ASKED = f"SELECT * REPLACE (text || CASE WHEN input_order%9=0 THEN ' {fv.ACTION_WORDS[0]}' WHEN input_order%9=1 THEN ' {fv.RISK_WORDS[0]}' WHEN input_order%9=2 THEN ' {fv.ACTION_WORDS[1]}{fv.RISK_WORDS[2]}' ELSE '' END AS text) FROM messages"


def asked(s, d):
    """Messages of which every ninth asks for something, every ninth reports a fault, every ninth both."""
    turn = F.col("input_order") % 9
    return v.messages(s, d).withColumn("text", F.concat("text", F.when(turn == 0, f" {fv.ACTION_WORDS[0]}").when(turn == 1, f" {fv.RISK_WORDS[0]}").when(turn == 2, f" {fv.ACTION_WORDS[1]}{fv.RISK_WORDS[2]}").otherwise("")))


query("signals", duck("messages", f"""SELECT group_id, row_id, sent_at, input_order, signal, from_end FROM (SELECT *, row_number() OVER (PARTITION BY group_id, signal ORDER BY sent_at DESC, input_order DESC) AS from_end FROM (
  SELECT group_id, row_id, sent_at, input_order, 'action' AS signal FROM asked WHERE regexp_matches(text,'(?i){"|".join(fv.ACTION_WORDS)}') UNION ALL SELECT group_id, row_id, sent_at, input_order, 'risk' FROM asked WHERE regexp_matches(text,'(?i){"|".join(fv.RISK_WORDS)}'))) WHERE from_end<=80""", asked=_ASKED))(
    lambda s, d: ct.signals(asked(s, d)))


def keyword_rules(s, d):
    """A rule table: the eight leading keywords of every group, their first character is the signal."""
    words = ct.top_tokens(v.tokened(s, d), 8).select("token").distinct()
    return words.select(F.lit("signal").alias("ruleset"), F.lit(0).alias("position"), F.lit("folded").alias("kind"), F.col("token").alias("pattern"), F.substring("token", 1, 1).alias("value"))


query("signals_by_rules", duck("messages", """SELECT group_id, row_id, signal, from_end FROM (SELECT *, row_number() OVER (PARTITION BY group_id, signal ORDER BY sent_at DESC, input_order DESC) AS from_end FROM (
  SELECT DISTINCT m.group_id, m.row_id, m.sent_at, m.input_order, substr(w.token,1,1) AS signal FROM messages m JOIN words w ON contains(lower(m.text), w.token))) WHERE from_end<=80""",
    words=f"SELECT DISTINCT token FROM ({IMPORTANT}) WHERE token_rank<=8"))(
    lambda s, d: ct.signals(v.messages(s, d), rules=keyword_rules(s, d)).select("group_id", "row_id", "signal", "from_end"))
query("last_n", duck("heads", "SELECT group_id, row_id, from_end FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sent_at DESC, input_order DESC) AS from_end FROM heads) WHERE from_end<=40"))(
    lambda s, d: ct.last_n(v.heads(s, d), ["group_id"], 40).select("group_id", "row_id", "from_end"))
query("filter_group", duck("heads", "SELECT row_id, sent_at FROM heads WHERE group_id='1007'"))(lambda s, d: ct.filter_group(v.heads(s, d), "1007").select("row_id", "sent_at"))
query("analysis_header", duck("heads chat_media group_names", f"""SELECT t.group_id, coalesce(n.name,'') AS name, t.c AS text_messages, coalesce(m.c,0) AS media_messages, coalesce(m.r,0) AS media_refs, {local_sql('t.a')} AS first_local, {local_sql('t.b')} AS last_local
  FROM (SELECT group_id, count(*) AS c, min(sent_at) AS a, max(sent_at) AS b FROM heads WHERE is_media=0 GROUP BY 1) t LEFT JOIN (SELECT group_id, count(DISTINCT row_id) AS c, count(*) AS r FROM chat_media GROUP BY 1) m ON m.group_id=t.group_id LEFT JOIN group_names n ON n.group_id=t.group_id"""))(
    lambda s, d: ct.analysis_header(v.heads(s, d).filter("is_media = 0"), v.chat_media(s, d), v.group_names(s, d)))


def raw_rows(s, d):
    eid = F.col("input_order")
    return v.heads(s, d).withColumn("msg_type1", F.when(eid % 5 == 0, 5).otherwise(2).cast("long")).withColumn("msg_type2", (eid % 3).cast("long"))


RAW = "SELECT *, CAST(CASE WHEN input_order%5=0 THEN 5 ELSE 2 END AS BIGINT) AS msg_type1, input_order%3 AS msg_type2 FROM heads"
query("type_distribution", duck("heads", "SELECT msg_type1, msg_type2, count(*) AS count FROM raw GROUP BY 1,2", raw=RAW))(lambda s, d: ct.type_distribution(raw_rows(s, d)))
query("type_samples", duck("heads", "SELECT group_id, row_id, sample FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sent_at DESC, input_order DESC) AS sample FROM heads) WHERE sample<=120"))(
    lambda s, d: ct.type_samples(raw_rows(s, d)).select("group_id", "row_id", "sample"))

# ---- topics ----
_PAIRS = f"SELECT DISTINCT m.group_id, m.row_id, m.sent_at, m.input_order, m.text_length, m.token FROM (SELECT group_id, row_id, sent_at, input_order, length(text) AS text_length, unnest({TOKENS}) AS token FROM messages) m JOIN imp i ON i.group_id=m.group_id AND i.token=m.token"


def important(s, d):
    return ct.shared_top_tokens(*v.shown(s, d), tp.IMPORTANT_TOKENS)


def rows(s, d):
    return tp.marked(v.tokened(s, d), important(s, d))


query("important_tokens", duck("messages", IMPORTANT))(lambda s, d: tp.important_tokens(v.tokened(s, d)))
query("incidence", duck("messages", "SELECT group_id, row_id, token FROM pairs", imp=IMPORTANT, pairs=_PAIRS))(lambda s, d: tp.incidence(v.tokened(s, d), important(s, d)))
_SEEDS = "SELECT group_id, row_id, sent_at, input_order, text_length, count(*) AS token_count FROM pairs GROUP BY ALL"
query("seed_order", duck("messages", f"SELECT group_id, row_id, token_count, text_length FROM ({_SEEDS})", imp=IMPORTANT, pairs=_PAIRS))(
    lambda s, d: tp.seed_order(rows(s, d)).select("group_id", "row_id", "token_count", F.col("text_length").cast("long")))


@query("topic_score", duck("messages", """SELECT p.group_id, p.row_id, CAST(count(*)*30 + CASE WHEN abs(p.sent_at-s.sent_at)<=10800 THEN 10 WHEN abs(p.sent_at-s.sent_at)<=43200 THEN 4 ELSE 0 END AS BIGINT) AS score
  FROM pairs p JOIN pairs s ON s.group_id=p.group_id AND s.token=p.token JOIN (SELECT group_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY token_count DESC, text_length DESC, input_order) AS r FROM seeds) WHERE r=1) f
  ON f.group_id=s.group_id AND f.row_id=s.row_id GROUP BY p.group_id, p.row_id, p.sent_at, s.sent_at""", imp=IMPORTANT, pairs=_PAIRS, seeds=_SEEDS))
def _topic_score(s, d):
    found = rows(s, d)
    seeds = tp.seed_order(found).groupBy("group_id").agg(F.min_by(F.struct("tokens", "sent_at"), "seed_key").alias("x")).select(
        "group_id", F.col("x.tokens").alias("seed_tokens"), F.col("x.sent_at").alias("seed_at"))
    return tp.score(seeds, found).select("group_id", "row_id", "score")


# one row per group and topic: the rows used so far and the place of the last seed
_PLACED = f"SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY token_count DESC, text_length DESC, input_order, row_id) AS place FROM (SELECT group_id, row_id, sent_at, input_order, text_length, count(*) AS token_count, list(token) AS held FROM pairs GROUP BY ALL)"
_GREEDY = """WITH RECURSIVE placed AS MATERIALIZED (SELECT * FROM placed0), found AS (
  SELECT group_id, 0 AS topic, 0 AS place, []::VARCHAR[] AS used, []::VARCHAR[] AS best FROM placed GROUP BY 1
  UNION ALL
  SELECT group_id, topic + 1, place, list_concat(used, best), best FROM (
    WITH free AS (SELECT r.*, f.topic, f.place AS after, f.used FROM found f JOIN placed r ON r.group_id=f.group_id WHERE f.topic < 12 AND NOT list_contains(f.used, r.row_id)),
      shared AS (SELECT group_id, list(token) AS tokens FROM (SELECT group_id, token FROM (SELECT group_id, unnest(held) AS token FROM free) GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1),
      seed AS (SELECT f.group_id, min(f.place) AS place FROM free f JOIN shared h ON h.group_id=f.group_id WHERE f.place > f.after AND list_has_any(f.held, h.tokens) GROUP BY 1),
      chosen AS (SELECT p.group_id, p.place, p.held, p.sent_at FROM seed JOIN placed p ON p.group_id=seed.group_id AND p.place=seed.place),
      scored AS (SELECT f.group_id, f.topic, c.place, f.used, f.row_id, row_number() OVER (PARTITION BY f.group_id ORDER BY
          len(list_intersect(f.held, c.held)) * 30 + CASE WHEN abs(f.sent_at-c.sent_at)<=10800 THEN 10 WHEN abs(f.sent_at-c.sent_at)<=43200 THEN 4 ELSE 0 END DESC, f.sent_at, f.input_order, f.row_id) AS r
        FROM free f JOIN chosen c ON c.group_id=f.group_id WHERE list_has_any(f.held, c.held))
    SELECT group_id, topic, place, used, list(row_id) AS best FROM scored WHERE r <= 80 GROUP BY group_id, topic, place, used))
  , members AS (SELECT group_id, CAST(topic AS BIGINT) AS topic, unnest(best) AS row_id FROM found WHERE topic > 0)
  SELECT group_id, topic, row_id FROM members UNION ALL
  SELECT group_id, CAST(0 AS BIGINT), row_id FROM messages m WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.group_id=m.group_id AND x.row_id=m.row_id)"""


@query("topics", duck("messages", f"SELECT group_id, topic, row_id FROM ({_GREEDY})", imp=IMPORTANT, pairs=_PAIRS, placed0=_PLACED))
def _topics(s, d):
    return tp.with_residual(v.messages(s, d), tp.assign_topics(v.tokened(s, d), ranked=important(s, d)))


def members(s, d, messages=v.messages):
    """Messages with a ready topic per group: the local week they were sent in."""
    return messages(s, d).withColumn("topic", (F.floor((F.col("sent_at") - v.START) / 604800) + 1).cast("long"))


def leading(s, d, n):
    """The leading tokens of the ready topics."""
    said, bodies = v.shown(s, d)
    return ct.shared_top_tokens(members(s, d, lambda *_: said), bodies, n, ["group_id", "topic"])


def named_topics(s, d):
    """The ready topics, summed up and named."""
    ranked = durable(leading(s, d, 10))
    return tp.topic_summary(members(s, d), ranked=ranked).join(tp.topic_names(members(s, d, v.headed), ranked), ["group_id", "topic"])


_MEMBERS = f"SELECT *, (sent_at-{v.START})//604800+1 AS topic FROM messages"
_TSTATS = f"SELECT group_id, topic, token, count(*) AS count, count(DISTINCT row_id) AS messages FROM (SELECT group_id, topic, row_id, unnest({TOKENS}) AS token FROM members) GROUP BY 1,2,3 HAVING count(DISTINCT row_id)>=2 OR count(*)>=3"
_TRANK = "SELECT *, row_number() OVER (PARTITION BY group_id, topic ORDER BY messages DESC, count DESC, token) AS r FROM tstats"
query("topic_names", duck("messages", """SELECT group_id, topic, string_agg(token,' / ' ORDER BY r) AS name FROM trank WHERE r<=4 GROUP BY 1,2""", members=_MEMBERS, tstats=_TSTATS, trank=_TRANK))(
    lambda s, d: tp.topic_names(members(s, d, v.headed), leading(s, d, 4)))
query("topic_summary", duck("messages", """SELECT m.*, p.top_speakers, coalesce(k.keywords,'') AS keywords FROM (SELECT group_id, topic, count(*) AS message_count, min(sent_at) AS first_unix, max(sent_at) AS last_unix FROM members GROUP BY 1,2) m JOIN (
  SELECT group_id, topic, string_agg(speaker || ':' || n, ',' ORDER BY n DESC, speaker) AS top_speakers FROM (SELECT *, row_number() OVER (PARTITION BY group_id, topic ORDER BY n DESC, speaker) AS r FROM (SELECT group_id, topic, speaker, count(*) AS n FROM members GROUP BY 1,2,3)) WHERE r<=8 GROUP BY 1,2) p ON p.group_id=m.group_id AND p.topic=m.topic
  LEFT JOIN (SELECT group_id, topic, string_agg(token || ':' || messages, ',' ORDER BY r) AS keywords FROM trank WHERE r<=10 GROUP BY 1,2) k ON k.group_id=m.group_id AND k.topic=m.topic""", members=_MEMBERS, tstats=_TSTATS, trank=_TRANK))(
    lambda s, d: tp.topic_summary(members(s, d), ranked=leading(s, d, 10)))
query("topic_samples", duck("messages", "SELECT group_id, topic, row_id, from_end FROM (SELECT *, row_number() OVER (PARTITION BY group_id, topic ORDER BY sent_at DESC, input_order DESC) AS from_end FROM members) WHERE from_end<=40", members=_MEMBERS))(
    lambda s, d: tp.topic_samples(members(s, d)).select("group_id", "topic", "row_id", "from_end"))


def media_topic(s, d):
    """Pseudo topic of the media messages of each group."""
    m = v.chat_media(s, d).withColumn("topic", F.lit(-1).cast("long"))
    return m.groupBy("group_id").agg(F.count_distinct("row_id").alias("message_count"), F.min("sent_at").alias("first_unix"), F.max("sent_at").alias("last_unix")).withColumn("name", F.lit(fv.MEDIA_TOPIC))


query("media_topic", duck("chat_media", f"SELECT group_id, count(DISTINCT row_id) AS message_count, min(sent_at) AS first_unix, max(sent_at) AS last_unix, '{fv.MEDIA_TOPIC}' AS name FROM chat_media GROUP BY 1"))(media_topic)

# ---- chunks ----
LINES = f"""SELECT m.group_id, m.row_id, m.sent_at, m.input_order, length('[' || {local_sql('m.sent_at')} || '] [' || {LABEL} || '] ' || m.speaker || ': ' || {trim_sql("regexp_replace(m.text, '[" + chr(92) + "s" + chr(92) + "x0B]+', ' ', 'g')")}) AS line_length
  FROM messages m LEFT JOIN group_names n ON n.group_id=m.group_id"""


def lines(s, d):
    return ch.summary_lines(v.messages(s, d), v.group_names(s, d))


_NUMBERED = """SELECT group_id, row_id, line_length, row_number() OVER w AS n, sum(line_length+1) OVER w AS upto FROM l WINDOW w AS (PARTITION BY group_id ORDER BY sent_at, input_order, row_id)"""
_NEXT = """SELECT a.group_id, a.n, min(b.n) AS nxt FROM o a JOIN o b ON b.group_id=a.group_id AND b.n>a.n AND b.n<=a.n+50 AND (b.n=a.n+50 OR b.upto-a.upto+a.line_length+1>40000) GROUP BY 1,2"""
_PACKED = """SELECT o.group_id, o.row_id, o.n AS line_no, s.chunk FROM o ASOF JOIN (WITH RECURSIVE starts AS (SELECT DISTINCT group_id, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS chunk FROM o
  UNION ALL SELECT s.group_id, x.nxt, s.chunk+1 FROM starts s JOIN nx x ON x.group_id=s.group_id AND x.n=s.n) SELECT * FROM starts) s ON s.group_id=o.group_id AND o.n>=s.n"""
query("pack_chunks", duck("messages group_names", _PACKED, l=LINES, o=_NUMBERED, nx=_NEXT))(lambda s, d: ch.pack_chunks(lines(s, d), 50, 40000))


@query("chunk_coverage", duck("messages group_names", """SELECT group_id, count(*) AS total_messages, count(*) FILTER (chunk<=6) AS included_messages, least(max(chunk),6) AS chunks, max(chunk)>6 AS capped, CASE WHEN max(chunk)<=1 THEN 'single' ELSE 'mapreduce' END AS mode FROM p GROUP BY 1""",
                              l=LINES, o=_NUMBERED, nx=_NEXT, p=_PACKED))
def _chunk_coverage(s, d):
    all_lines = lines(s, d)
    return ch.chunk_coverage(all_lines, ch.pack_chunks(all_lines, 50, 40000, 6))


query("cap_tail", duck("messages group_names", """SELECT group_id, row_id, from_end FROM (SELECT *, min(CASE WHEN from_end>1 AND before+line_length>20000 THEN from_end END) OVER (PARTITION BY group_id) AS stop FROM (
  SELECT *, coalesce(sum(line_length+1) OVER (PARTITION BY group_id ORDER BY from_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sent_at DESC, input_order DESC) AS from_end FROM l) WHERE from_end<=400)) WHERE stop IS NULL OR from_end<stop""", l=LINES))(
    lambda s, d: ch.cap_tail(lines(s, d), 400, 20000).select("group_id", "row_id", "from_end"))
query("cap_head", duck("messages group_names", """SELECT group_id, row_id, from_end FROM (SELECT *, sum(line_length) OVER (PARTITION BY group_id ORDER BY from_end DESC ROWS UNBOUNDED PRECEDING) AS used FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sent_at DESC, input_order DESC) AS from_end FROM l) WHERE from_end<=500) WHERE used<=50000""", l=LINES))(
    lambda s, d: ch.cap_head(lines(s, d)).select("group_id", "row_id", "from_end"))


@query("summary_requests")
def _requests(s, d):
    bodies = v.table(s, d, "documents").select(F.col("doc_id").alias("body_id"), F.explode(F.array(ch.flat_text("text"))).alias("body"))
    all_lines = ch.line_heads(v.heads(s, d).withColumnRenamed("doc_id", "body_id"), v.group_names(s, d), bodies)
    named = named_topics(s, d)
    header = ct.analysis_header(v.heads(s, d), v.chat_media(s, d), v.group_names(s, d))
    return ch.summary_requests(all_lines, ch.pack_chunks(all_lines, 50, 40000), header, named, ct.time_blocks(v.heads(s, d)), bodies).withColumn("request", F.md5("request"))


def partial_answers(s, d, blank=""):
    """Partial summaries shaped from the conversations: one part per (conversation, turn). Where ``blank``
    is given, it stands for what a short text or a null turn leaves empty."""
    rows = v.texts(s, d, "conversations", "conv_id").filter("text is not null")
    words = F.split("text", " ")
    filled = (lambda c: F.when(tx.trim_space(c) != "", c).otherwise(blank)) if blank else lambda c: c
    estimate = (F.col("turn") + 1).cast("double")
    title = filled(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))))
    topic = F.struct(title.alias("title"), filled(F.substring("text", 1, 200)).alias("summary"), F.when(F.col("turn") % 3 == 0, "high").otherwise("low").alias("importance"),
                     (F.coalesce(estimate, F.lit(0.0)) if blank else estimate).alias("messageCountEstimate"), F.array(F.lit("d1"), filled(F.get(words, F.lit(2)))).alias("details"), F.array(F.lit("e1")).alias("evidence"))
    action = F.struct(F.col("role").alias("owner"), filled(F.get(words, F.lit(0))).alias("task"), F.when(F.col("turn") % 2 == 1, "resolved").otherwise("open").alias("status"), F.lit("r").alias("resolution"), F.lit("ev").alias("evidence"))
    answer = F.to_json(F.struct(title.alias("summary"), F.array(topic).alias("topics"), F.array(action).alias("actions")))
    return rows.select(F.col("conv_id").cast("string").alias("group_id"), (F.col("turn") + 1).alias("chunk"), answer.alias("answer"))


_PART = """SELECT CAST(conv_id AS VARCHAR) AS group_id, turn+1 AS part, w[1] AS w1, w[2] AS w2, w[3] AS w3, array_to_string(w[1:2],' ') AS title, turn, role, text FROM (SELECT *, str_split(text,' ') AS w FROM conversations WHERE text IS NOT NULL)"""
_TK = f"lower({trim_sql(rep('title', SPACE + '+', ' '))})"
query("merge_topics", duck("", f"""SELECT group_id, title, message_count_estimate, importance, rank FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY message_count_estimate DESC, first_at) AS rank FROM (
  SELECT group_id, arg_min({trim_sql('title')}, part) AS title, min(part) AS first_at, sum(part)::DOUBLE AS message_count_estimate, CASE WHEN bool_or(turn%3=0) THEN 'high' ELSE 'low' END AS importance FROM p WHERE {trim_sql('title')}<>'' GROUP BY group_id, {_TK})) WHERE rank<=10""", p=_PART))(
    lambda s, d: ch.merge_topics(ch.normalize_summary(partial_answers(s, d))).select("group_id", "title", "message_count_estimate", "importance", "rank"))
query("merge_actions", duck("", f"""SELECT group_id, task, status, rank FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY status='resolved', first_at) AS rank FROM (
  SELECT group_id, arg_min(w1, part) AS task, min(part) AS first_at, CASE WHEN bool_or(turn%2=1) THEN 'resolved' ELSE 'open' END AS status FROM p WHERE {trim_sql('w1')}<>'' GROUP BY group_id, lower({trim_sql(rep('w1', SPACE + '+', ' '))}))) WHERE rank<=15""", p=_PART))(
    lambda s, d: ch.merge_actions(ch.normalize_summary(partial_answers(s, d))).select("group_id", "task", "status", "rank"))
def damaged_answers(s, d):
    """The partial answers, of which some are cut, some rate an odd importance and some lack evidence; nothing else is wrong with any."""
    turn = F.col("chunk") + F.col("group_id").cast("long")
    return partial_answers(s, d, "-").withColumn("answer", F.when(turn % 5 == 0, F.substring("answer", 1, 20)).when(turn % 5 == 1, F.replace("answer", F.lit('"importance":"'), F.lit('"importance":"odd '))).when(
        turn % 5 == 2, F.regexp_replace("answer", '"evidence":\\["e1"\\]', '"evidence":[]')).otherwise(F.col("answer")))


query("normalize_summary", duck("", """SELECT CASE (turn+1+conv_id)%5 WHEN 0 THEN 'not-json' WHEN 1 THEN 'topic' END AS reason, count(*) AS count FROM conversations WHERE text IS NOT NULL GROUP BY 1"""))(lambda s, d: ch.normalize_summary(damaged_answers(s, d)).groupBy("reason").count())
query("trim_partial", duck("", "SELECT group_id, part AS chunk, 1 AS topics, 1 AS actions FROM p", p=_PART))(lambda s, d: ch.trim_partial(ch.normalize_summary(partial_answers(s, d))).select("group_id", "chunk", F.size("p.topics").alias("topics"), F.size("p.actions").alias("actions")))
query("quick_summary", duck("", "SELECT group_id, title AS summary, 0 AS actions FROM p", p=_PART))(lambda s, d: ch.quick_summary(partial_answers(s, d)).select("group_id", "summary", F.size("actions").alias("actions")))
query("merge_partials", duck("", f"SELECT group_id, string_agg(t, ' ' ORDER BY part) AS summary FROM (SELECT group_id, part, {trim_sql('title')} AS t, row_number() OVER (PARTITION BY group_id ORDER BY part) AS r FROM p WHERE {trim_sql('title')}<>'') WHERE r<=4 GROUP BY 1", p=_PART))(lambda s, d: ch.merge_partials(ch.normalize_summary(partial_answers(s, d)))["summary"])
query("evidence_range", duck("heads", "SELECT row_id, sent_at-3600-600 AS from_unix, sent_at+600 AS to_unix FROM heads"))(
    lambda s, d: v.heads(s, d).select("row_id", val.evidence_range(F.array(F.concat(F.lit("at "), val.to_local("sent_at"), F.lit(" said")), F.lit("no time"), val.to_local(F.col("sent_at") - 3600))).alias("r")).select("row_id", "r.*"))
query("importance_rank", duck("", "SELECT o_orderkey, CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '3%' THEN 1 WHEN o_orderpriority LIKE '5%' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM orders"))(
    lambda s, d: v.table(s, d, "orders").select("o_orderkey", val.importance_rank(F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").when(F.col("o_orderpriority").startswith("5"), "low").otherwise("x")).alias("rank")))
query("display_text", duck("messages", f"SELECT row_id, CASE WHEN is_media=1 THEN '[图片]' || CASE WHEN {trim_sql('text')}<>'' THEN ' ' || {trim_sql('text')} ELSE '' END ELSE text END AS shown FROM messages"))(
    lambda s, d: v.messages(s, d).select("row_id", val.display_text(F.col("media_kinds"), F.col("text"), F.col("is_media")).alias("shown")))
query("bare_row_id", duck("heads", "SELECT row_id, input_order, CAST(input_order AS VARCHAR) AS bare FROM heads"))(lambda s, d: v.heads(s, d).select("row_id", "input_order", val.bare_row_id("row_id").alias("bare")))
query("run_created", duck("heads", "SELECT row_id, CASE WHEN sent_at%4=0 THEN NULL ELSE sent_at END AS created FROM heads"))(
    lambda s, d: v.heads(s, d).select("row_id", val.run_created(F.when(F.col("sent_at") % 4 == 0, "chat-x").otherwise(F.concat(F.lit("chat-"), F.date_format(F.from_utc_timestamp(F.timestamp_seconds("sent_at"), val.ZONE), "yyyyMMdd-HHmmss")))).alias("created")))
query("format_bytes", duck("images", "SELECT hash, CASE WHEN file_size<1024 THEN file_size || ' B' ELSE printf('%.2f', round(file_size/1024.0, 2)) || ' KB' END AS size FROM images"))(lambda s, d: v.images(s, d).select("hash", val.format_bytes("file_size").alias("size")))
