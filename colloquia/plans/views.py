"""Canonical tables of the engine, derived from the Parquet folder in ``sf_dir``.

Every view exists twice: as a DataFrame here and as portable SQL in ``DUCK_VIEWS``. No
view filters by id or cuts texts; all of them grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquia.functions.text import text_head, token_counts
from colloquia.session import tune

START = 1704067200  # 2024-01-01 00:00:00 UTC
END = START + 30 * 86400
SLOT = 6 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly over the tasks, whatever the files are like. With a number, adaptive
    execution leaves the partitions apart: text work is CPU, however few bytes it reads."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return dealt(table(spark, sf_dir, name), key)


def _group(column: str):
    return (F.lit(1001) + F.col(column) % 25).cast("string").alias("group_id")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without their text: no join, narrow scan."""
    events = table(spark, sf_dir, "events")
    view = F.col("event_type") == "view"
    return events.select(
        _group("user_id"),
        F.when(view, F.concat(F.lit("m"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string")).alias("row_id"),
        F.unix_timestamp("ts").alias("sent_at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("speaker"),
        view.cast("long").alias("is_media"), F.when(view, "image").otherwise("").alias("media_kinds"),
        F.col("user_id").cast("string").alias("speaker_uin"), F.col("event_id").alias("input_order"),
        F.expr("event_id div 10").alias("doc_id"), "event_type")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "documents").select("doc_id", "text")
    # dealt before the join, by its key, so that heads move once: a filter on the text would move in front of a later shuffle
    return dealt(heads(spark, sf_dir), "doc_id").join(bodies, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def tokened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the token counts and heads of their texts, which are computed once a text,
    before it meets the messages that show it."""
    counts = F.explode(F.array(token_counts("text"))).alias("token_counts")  # a generator: no filter computes them again
    bodies = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", text_head("text").alias("head"), counts)
    shown = dealt(heads(spark, sf_dir), "doc_id").join(bodies, "doc_id", "left")
    return shown.withColumns({c: F.coalesce(c, F.lit("")) for c in ("text", "head")}).withColumn("token_counts", F.coalesce("token_counts", F.array().cast("array<struct<token:string,n:bigint>>")))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the heads of their texts, which are cut once a text."""
    bodies = texts(spark, sf_dir, "documents", "doc_id").select("doc_id", F.explode(F.array(text_head("text"))).alias("head"))
    return dealt(heads(spark, sf_dir), "doc_id").join(bodies, "doc_id", "left").withColumn("head", F.coalesce("head", F.lit("")))


def shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages and the texts they show, apart. Messages whose text is missing show an empty one, without a token."""
    return (dealt(heads(spark, sf_dir), "doc_id").withColumnRenamed("doc_id", "text_id"),
            texts(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("text_id"), "text"))


def scan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.lit(START) + (key * 7919) % 2592000
    return table(spark, sf_dir, "orders").select(
        _group("o_custkey"), start.alias("start_unix"), (start + 60 + (key * 104729) % 600).alias("end_unix"),
        F.concat(F.lit("run-"), (key % 7).cast("string")).alias("run_id"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.lit(1001) + F.col("n_nationkey")).cast("string").alias("group_id"))


def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one region carry no name."""
    return table(spark, sf_dir, "nation").select(
        (F.lit(1001) + F.col("n_nationkey")).cast("string").alias("group_id"),
        F.when(F.col("n_regionkey") == 3, "").otherwise(F.col("n_name")).alias("name"))


def read_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one region were never opened."""
    return table(spark, sf_dir, "nation").filter("n_regionkey <> 4").select(
        (F.lit(1001) + F.col("n_nationkey")).cast("string").alias("group_id"),
        (F.lit(START) + F.col("n_nationkey").cast("long") * 86400).alias("sent_at"), F.lit("").alias("row_id"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_regionkey in (1, 2)").select(
        (F.lit(1001) + F.col("n_nationkey")).cast("string").alias("group_id"), F.col("n_name").alias("name"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = key.cast("string")
    return table(spark, sf_dir, "part").select(
        F.md5(text).alias("hash"),
        F.when((key % 10).isin(0, 5), "").otherwise(F.concat(F.lit("cache/"), text, F.lit(".png"))).alias("file_path"),
        (F.col("p_size").cast("long") * 1000).alias("file_size"),
        (F.lit(START) + (key * 7919) % 5184000).alias("file_mtime"),
        (F.lit(512) + 128 * (key % 5)).alias("width"), (F.lit(512) + 128 * (key % 7)).alias("height"),
        F.element_at(F.array(*map(F.lit, ["forge", "webui", "comfyui", "nai", "stripped"])), (key % 5 + 1).cast("int")).alias("generator"),
        F.when(key % 5 == 4, "").otherwise(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")), F.lit(", ("), F.lower("p_type"), F.lit(":1.2)"))).alias("prompt"),
        F.when(key % 3 == 0, "low quality").otherwise("").alias("negative_prompt"), F.col("p_brand").alias("checkpoint"),
        F.concat(F.lit('{"steps":'), F.col("p_size").cast("string"), F.lit(',"cfgScale":'), (1 + key % 9).cast("string"),
                 F.lit(',"seed":"'), text, F.lit('"}')).alias("params_json"),
        (key % 10 == 0).cast("long").alias("file_missing"),
        F.when(key % 20 == 0, F.concat(F.lit("objects/"), text)).otherwise("").alias("object_path"),
        F.lit(2).cast("long").alias("parser_version"), F.lit(START).cast("long").alias("parsed_at"))


def image_loras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One style per part; a part of an even brand number adds a second."""
    key = F.col("p_partkey")
    base = table(spark, sf_dir, "part")
    first = base.select(F.md5(key.cast("string")).alias("hash"), F.concat(F.lit("style-"), (key % 9).cast("string")).alias("lora_name"))
    second = base.filter("p_size > 25").select(F.md5(key.cast("string")).alias("hash"), F.concat(F.lit("detail-"), (key % 4).cast("string")).alias("lora_name"))
    return first.unionByName(second)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line shows a picture; those of every eleventh part show one the catalog lacks."""
    part = F.col("l_partkey").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        F.md5(F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("lost-"), part)).otherwise(part)).alias("hash"), _group("l_suppkey"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("row_id"),
        (F.lit(START) + (F.col("l_orderkey") * 7919) % 2592000).alias("sent_at"),
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("speaker"))
    return rows.groupBy("hash", "group_id", "row_id").agg(F.max("sent_at").alias("sent_at"), F.min("speaker").alias("speaker"))


def named_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).join(group_names(spark, sf_dir).withColumnRenamed("name", "group_name"), "group_id", "left").withColumn(
        "group_name", F.coalesce("group_name", F.lit("")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored requests: every error event asks about the image named by its document."""
    eid = F.col("event_id")
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        _group("user_id"), eid.cast("string").alias("ask_row_id"), F.unix_timestamp("ts").alias("ask_sent_at"),
        F.when(eid % 2 == 0, "prompt").otherwise("original").alias("intent"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("asker"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(F.md5(F.expr("cast(event_id div 10 as string)"))).alias("image_hash"),
        F.when(eid % 3 == 0, "").when(eid % 2 == 0, "text").otherwise("media").alias("answer_kind"),
        F.when((eid % 3 != 0) & (eid % 2 == 0), F.concat(F.lit(" answer "), eid.cast("string"))).otherwise("").alias("answer_text"),
        F.when((eid % 3 != 0) & (eid % 2 == 1), F.md5(F.expr("cast(event_id div 20 as string)"))).alias("answer_hash"))


def media_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    return table(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.concat(F.lit("run-"), (eid % 5).cast("string")).alias("run_id"), _group("user_id"), eid.cast("string").alias("row_id"),
        F.unix_timestamp("ts").alias("sent_at"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("speaker"),
        F.when(eid % 4 == 0, "video").otherwise("image").alias("kind"), (F.lit(1000) + (eid * 104729) % 900000).alias("bytes"),
        F.concat(F.lit("/m/"), eid.cast("string"), F.when(eid % 4 == 0, ".mp4").when(eid % 9 == 0, ".bin").otherwise(".png")).alias("web_path"),
        F.md5(F.expr("cast(event_id div 10 as string)")).alias("content_key"), eid.alias("input_order"))


def chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text messages of the ask/answer exchange: error events ask, purchases may answer."""
    eid = F.col("input_order")
    rows = messages(spark, sf_dir).filter("is_media = 0")
    asks = F.element_at(F.array(*[F.lit(t) for t in ASK_TEXTS]), (eid % len(ASK_TEXTS) + 1).cast("int"))
    answers = F.when(eid % 3 == 0, F.concat(F.lit("Steps: 20, Sampler: Euler a, Seed: "), eid.cast("string"))).otherwise(
        F.concat(F.lit("masterpiece, best quality, 1girl, solo, no "), eid.cast("string")))
    return rows.select("group_id", "row_id", "sent_at", F.col("speaker_uin").alias("sender"), "speaker", "input_order",
                       F.when(F.col("event_type") == "error", asks).when(F.col("event_type") == "purchase", answers).otherwise(F.col("text")).alias("text"))


def chat_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posted media reference."""
    eid = F.col("input_order")
    return heads(spark, sf_dir).filter("is_media = 1").select(
        "group_id", F.expr("substring(row_id, 2)").alias("row_id"), "sent_at", F.col("speaker_uin").alias("sender"), "speaker", "input_order",
        F.when(eid % 11 == 0, "emoji").when(eid % 4 == 0, "video").otherwise("image").alias("kind"),
        F.md5(F.col("doc_id").cast("string")).alias("hash"), F.concat(F.md5(F.col("doc_id").cast("string")), F.lit(".png")).alias("file_name"))


def quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).filter("event_type = 'error' and input_order % 3 = 0").select(
        "group_id", "row_id", F.array(F.md5(F.col("doc_id").cast("string"))).alias("quoted_hashes"))


# fixed ask phrases used by the test view; the fifth only counts beside a quoted image
ASK_TEXTS = ["kkt", "kko 谢谢", "求tag", "原图呢？", "发我原图", "kkt是什么", "今天天气不错"]

_ASK_SQL = "CASE " + " ".join(f"WHEN e.event_id % {len(ASK_TEXTS)} = {i} THEN '{t}'" for i, t in enumerate(ASK_TEXTS)) + " END"

DUCK_VIEWS = {
    "heads": """SELECT CAST(1001 + e.user_id % 25 AS VARCHAR) AS group_id,
        CASE WHEN e.event_type='view' THEN 'm' || CAST(e.event_id AS VARCHAR) ELSE CAST(e.event_id AS VARCHAR) END AS row_id,
        epoch_us(e.ts)//1000000 AS sent_at, 'user-' || CAST(e.user_id AS VARCHAR) AS speaker,
        CAST(CASE WHEN e.event_type='view' THEN 1 ELSE 0 END AS BIGINT) AS is_media,
        CASE WHEN e.event_type='view' THEN 'image' ELSE '' END AS media_kinds, CAST(e.user_id AS VARCHAR) AS speaker_uin,
        e.event_id AS input_order, e.event_id // 10 AS doc_id, e.event_type FROM events e""",
    "messages": """SELECT h.*, coalesce(d.text,'') AS text FROM heads h LEFT JOIN documents d ON d.doc_id = h.doc_id""",
    "scan_ranges": f"""SELECT CAST(1001 + o_custkey % 25 AS VARCHAR) AS group_id, {START} + (o_orderkey*7919) % 2592000 AS start_unix,
        {START} + (o_orderkey*7919) % 2592000 + 60 + (o_orderkey*104729) % 600 AS end_unix, 'run-' || CAST(o_orderkey % 7 AS VARCHAR) AS run_id FROM orders""",
    "groups": "SELECT CAST(1001 + n_nationkey AS VARCHAR) AS group_id FROM nation",
    "group_names": "SELECT CAST(1001 + n_nationkey AS VARCHAR) AS group_id, CASE WHEN n_regionkey = 3 THEN '' ELSE n_name END AS name FROM nation",
    "read_marks": f"""SELECT CAST(1001 + n_nationkey AS VARCHAR) AS group_id, CAST({START} + n_nationkey*86400 AS BIGINT) AS sent_at, '' AS row_id
        FROM nation WHERE n_regionkey <> 4""",
    "watchlist": "SELECT CAST(1001 + n_nationkey AS VARCHAR) AS group_id, n_name AS name FROM nation WHERE n_regionkey IN (1,2)",
    "images": f"""SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash,
        CASE WHEN p_partkey%10 IN (0,5) THEN '' ELSE 'cache/' || CAST(p_partkey AS VARCHAR) || '.png' END AS file_path,
        CAST(p_size AS BIGINT)*1000 AS file_size, {START} + (p_partkey*7919) % 5184000 AS file_mtime,
        512+128*(p_partkey%5) AS width, 512+128*(p_partkey%7) AS height,
        CASE p_partkey%5 WHEN 0 THEN 'forge' WHEN 1 THEN 'webui' WHEN 2 THEN 'comfyui' WHEN 3 THEN 'nai' ELSE 'stripped' END AS generator,
        CASE WHEN p_partkey%5=4 THEN '' ELSE replace(p_name,' ',', ') || ', (' || lower(p_type) || ':1.2)' END AS prompt,
        CASE WHEN p_partkey%3=0 THEN 'low quality' ELSE '' END AS negative_prompt, p_brand AS checkpoint,
        '{{"steps":' || CAST(p_size AS VARCHAR) || ',"cfgScale":' || CAST(1+p_partkey%9 AS VARCHAR) || ',"seed":"' || CAST(p_partkey AS VARCHAR) || '"}}' AS params_json,
        CAST(CASE WHEN p_partkey%10=0 THEN 1 ELSE 0 END AS BIGINT) AS file_missing,
        CASE WHEN p_partkey%20=0 THEN 'objects/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS object_path,
        CAST({START} AS BIGINT) AS parsed_at FROM part""",
    "image_loras": """SELECT md5(CAST(p_partkey AS VARCHAR)) AS hash, 'style-' || CAST(p_partkey%9 AS VARCHAR) AS lora_name FROM part
        UNION ALL SELECT md5(CAST(p_partkey AS VARCHAR)), 'detail-' || CAST(p_partkey%4 AS VARCHAR) FROM part WHERE p_size > 25""",
    "sightings": f"""SELECT md5(CASE WHEN l_partkey%11=0 THEN 'lost-' ELSE '' END || CAST(l_partkey AS VARCHAR)) AS hash, CAST(1001 + l_suppkey%25 AS VARCHAR) AS group_id,
        CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS row_id,
        max({START} + (l_orderkey*7919)%2592000) AS sent_at, min('supp-' || CAST(l_suppkey AS VARCHAR)) AS speaker
        FROM lineitem GROUP BY 1,2,3""",
    "named_sightings": "SELECT s.*, coalesce(n.name,'') AS group_name FROM sightings s LEFT JOIN group_names n ON n.group_id = s.group_id",
    "requests": """SELECT CAST(1001 + user_id % 25 AS VARCHAR) AS group_id, CAST(event_id AS VARCHAR) AS ask_row_id, epoch_us(ts)//1000000 AS ask_sent_at,
        CASE WHEN event_id%2=0 THEN 'prompt' ELSE 'original' END AS intent, 'user-' || CAST(user_id AS VARCHAR) AS asker,
        CASE WHEN event_id%7=0 THEN NULL ELSE md5(CAST(event_id//10 AS VARCHAR)) END AS image_hash,
        CASE WHEN event_id%3=0 THEN '' WHEN event_id%2=0 THEN 'text' ELSE 'media' END AS answer_kind,
        CASE WHEN event_id%3<>0 AND event_id%2=0 THEN ' answer ' || CAST(event_id AS VARCHAR) ELSE '' END AS answer_text,
        CASE WHEN event_id%3<>0 AND event_id%2=1 THEN md5(CAST(event_id//20 AS VARCHAR)) END AS answer_hash
        FROM events WHERE event_type='error'""",
    "media_index": """SELECT 'run-' || CAST(event_id%5 AS VARCHAR) AS run_id, CAST(1001 + user_id%25 AS VARCHAR) AS group_id, CAST(event_id AS VARCHAR) AS row_id,
        epoch_us(ts)//1000000 AS sent_at, 'user-' || CAST(user_id AS VARCHAR) AS speaker, CASE WHEN event_id%4=0 THEN 'video' ELSE 'image' END AS kind,
        1000 + (event_id*104729)%900000 AS bytes,
        '/m/' || CAST(event_id AS VARCHAR) || CASE WHEN event_id%4=0 THEN '.mp4' WHEN event_id%9=0 THEN '.bin' ELSE '.png' END AS web_path,
        md5(CAST(event_id//10 AS VARCHAR)) AS content_key, event_id AS input_order FROM events WHERE event_type='view'""",
    "chat_text": f"""SELECT CAST(1001 + e.user_id % 25 AS VARCHAR) AS group_id, CAST(e.event_id AS VARCHAR) AS row_id, epoch_us(e.ts)//1000000 AS sent_at,
        CAST(e.user_id AS VARCHAR) AS sender, 'user-' || CAST(e.user_id AS VARCHAR) AS speaker, e.event_id AS input_order,
        CASE WHEN e.event_type='error' THEN {_ASK_SQL}
             WHEN e.event_type='purchase' AND e.event_id%3=0 THEN 'Steps: 20, Sampler: Euler a, Seed: ' || CAST(e.event_id AS VARCHAR)
             WHEN e.event_type='purchase' THEN 'masterpiece, best quality, 1girl, solo, no ' || CAST(e.event_id AS VARCHAR)
             ELSE coalesce(d.text,'') END AS text
        FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id//10 WHERE e.event_type <> 'view'""",
    "chat_media": """SELECT CAST(1001 + user_id % 25 AS VARCHAR) AS group_id, CAST(event_id AS VARCHAR) AS row_id, epoch_us(ts)//1000000 AS sent_at,
        CAST(user_id AS VARCHAR) AS sender, 'user-' || CAST(user_id AS VARCHAR) AS speaker, event_id AS input_order,
        CASE WHEN event_id%11=0 THEN 'emoji' WHEN event_id%4=0 THEN 'video' ELSE 'image' END AS kind,
        md5(CAST(event_id//10 AS VARCHAR)) AS hash, md5(CAST(event_id//10 AS VARCHAR)) || '.png' AS file_name FROM events WHERE event_type='view'""",
    "quote_links": """SELECT CAST(1001 + user_id % 25 AS VARCHAR) AS group_id, CAST(event_id AS VARCHAR) AS row_id, md5(CAST(event_id//10 AS VARCHAR)) AS quoted_hash
        FROM events WHERE event_type='error' AND event_id % 3 = 0""",
    "merged": """SELECT group_id, min(start_unix) AS start_unix, max(end_unix) AS end_unix FROM (
        SELECT *, sum(CASE WHEN prev IS NULL OR start_unix > prev THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY start_unix, end_unix) AS blk FROM (
          SELECT *, max(end_unix) OVER (PARTITION BY group_id ORDER BY start_unix, end_unix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
          FROM scan_ranges)) GROUP BY group_id, blk""",
}

_NEEDS = {"messages": ["heads"], "named_sightings": ["sightings", "group_names"], "merged": ["scan_ranges"]}


def duck(views: str, body: str, **extra: str) -> str:
    """``body`` with the named views (and what they need) as leading CTEs."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        need(name)
    ctes = [f"{n} AS ({DUCK_VIEWS[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
