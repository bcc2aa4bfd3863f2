"""Readers of export documents, manifests, run artefacts and group lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquia.functions.media import MEDIA_REF, media_text
from colloquia.functions.text import light_clean, speaker
from colloquia.session import durable

WHOLE_BYTES = 64 << 20  # larger documents are read in splits

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
_REF = T.StructType([T.StructField(n, _S) for n in ("source", "kind", "extension", "hash", "fileName", "localPath", "url")])
_MESSAGE = [("groupId", _S), ("groupName", _S), ("rowId", _S), ("msgSeq", _S), ("msgType1", _S), ("msgType2", _S), ("sentAt", _L), ("senderUid", _S), ("senderUin", _S),
            ("senderName", _S), ("memberName", _S), ("memberUin", _S), ("text", _S), ("bodySnippet", _S), ("mediaRefs", T.ArrayType(_REF))]
EXPORT_SCHEMA = T.StructType([
    T.StructField("groupIds", T.ArrayType(_S)), T.StructField("groupNames", T.MapType(_S, _S)), T.StructField("startUnix", _L), T.StructField("endUnix", _L), T.StructField("scanned", _L),
    T.StructField("stopReason", _S), T.StructField("scanTruncated", _B), T.StructField("scanAborted", _B), T.StructField("coveredFromUnix", _L), T.StructField("matched", _L), T.StructField("matchedMedia", _L),
    T.StructField("errors", T.ArrayType(T.MapType(_S, _S))), T.StructField("messages", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _MESSAGE]))),
    T.StructField("mediaMessages", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _MESSAGE]))),
    T.StructField("quoteLinks", T.ArrayType(T.StructType([T.StructField("groupId", _S), T.StructField("rowId", _S), T.StructField("sentAt", _L), T.StructField("senderUin", _S), T.StructField("senderName", _S), T.StructField("quotedImageHashes", T.ArrayType(_S))])))])
MANIFEST_SCHEMA = T.StructType([T.StructField(n, _L if n in ("sentAt", "remoteStatusCode") else _S) for n in (
    "rowId", "sentAt", "hkt", "groupId", "groupName", "speaker", "kind", "hash", "fileName", "requestedExtension", "sourcePath", "copiedPath", "copyError", "url", "remoteUrl", "remoteStatus", "remoteStatusCode", "objectPath", "objectStatus")])


def parse_exports(documents: DataFrame) -> DataFrame:
    """Parse (file, value) rows of whole export documents; unreadable ones are dropped.

    The key test runs on the raw text: a schema read cannot tell an absent covered-from
    field from a null one.
    """
    keys = F.json_object_keys("value")
    return documents.select("file", F.from_json("value", EXPORT_SCHEMA).alias("d"), F.coalesce(F.array_contains(keys, "coveredFromUnix"), F.lit(False)).alias("has_covered")).filter("d.groupIds is not null")


def export_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole documents, one file per row; for those that fit a task (see ``document_parts``)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def document_parts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Export documents cut into small ones of at most one list element: (file, at, value).

    A document may be larger than any task: Spark reads it in byte-range splits, as records
    that end at ``}``. What a record does to the state (inside a string or not, nesting depth)
    is known for either start, and block summaries carry the state across splits. A part goes
    from the end of one element of a top-level list to the end of the next, inside the list
    it belongs to; ``at`` numbers the parts of a file. Documents that do not close give no part.
    """
    file, here = ["file"], ["file", "block"]
    raw = spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    bare = [F.regexp_replace(c, r'"[^"]*("|$)', "") for c in (F.col("clean"), F.concat(F.lit('"'), "clean"))]
    steps = [(count(b, "{") + count(b, "[") - count(b, "]") - F.when((F.col("q") + k) % 2 == 0, 1).otherwise(0)).alias(f"s{k}") for k, b in enumerate(bare)]
    list_key = F.regexp_extract("clean", r'"(\w+)"\s*:\s*\[\s*\{', 1).alias("list_key")
    cut = durable(raw.withColumn("clean", clean).withColumn("q", count(F.col("clean"), '"')).select("file", "block", "n", "value", "q", *steps, list_key, F.col("clean").rlike(r"^\s*\]").alias("closes")))
    order = Window.partitionBy(*here).orderBy("n")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*file).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    local = cut.withColumn("_q", F.coalesce(F.sum("q").over(earlier), none))
    for k in (0, 1):  # for a block that starts outside and inside a string
        local = local.withColumn(f"x{k}", F.when((F.col("_q") + k) % 2 == 0, F.col("s0")).otherwise(F.col("s1")))
    sums = local.groupBy(*here).agg(*[F.sum(c).alias(f"_{c}") for c in ("x0", "x1")], F.sum("q").alias("_quotes"))
    sums = sums.withColumn("inside", F.coalesce(F.sum("_quotes").over(blocks), none) % 2).withColumn("_x", F.when(F.col("inside") == 0, F.col("_x0")).otherwise(F.col("_x1")))
    sums = durable(sums.withColumn("base", F.coalesce(F.sum("_x").over(blocks), none)))
    closed = sums.groupBy(*file).agg((F.sum("_quotes") % 2).alias("open"), F.sum("_x").alias("depth")).filter("open = 0 and depth in (0, -1)").select(*file)  # -1: blanks after the last brace
    step = F.when(F.col("inside") == 0, F.col("x0")).otherwise(F.col("x1"))
    placed = local.join(sums.select(*here, "inside", "base"), here).join(closed, file, "left_semi").withColumn("step", step)
    placed = placed.withColumn("after", F.col("base") + F.sum("step").over(order)).withColumn("before", F.col("after") - F.col("step"))
    outside = (F.col("_q") + F.col("inside") + F.col("q")) % 2 == 0
    opens = (F.col("before") <= 1) | ((F.col("before") == 2) & F.col("closes"))
    placed = placed.withColumn("ends", (outside & (F.col("after") == 2)).cast("long")).withColumn("opened", F.when(opens, F.nullif("list_key", F.lit("")))).filter("before > 0 or trim(value) <> '' or n = 0")
    ended = F.coalesce(F.sum("ends").over(earlier), none)
    totals = placed.groupBy(*here).agg(F.sum("ends").alias("_ends"), F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("n"))).alias("_opened"))
    totals = totals.select(*here, F.coalesce(F.sum("_ends").over(blocks), none).alias("_at"), F.last("_opened", ignorenulls=True).over(blocks).alias("_list"))
    numbered = placed.withColumn("_ended", ended).withColumn("_opened", F.last("opened", ignorenulls=True).over(earlier)).join(totals, here).select(
        "file", (F.col("_at") + F.col("_ended")).alias("at"), F.struct("block", "n", "value").alias("piece"), F.struct("block", "n").alias("place"), "before", "after", F.coalesce("_opened", "_list").alias("list"))
    parts = numbered.groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["value"]), "}").alias("body"),
                                               F.min_by("before", "place").alias("before"), F.max_by("after", "place").alias("after"), F.min_by(F.struct("list"), "place").alias("in"))
    inside = F.concat(F.lit('{"'), F.col("in.list"), F.lit('":['), F.regexp_replace("body", r"^\s*,", ""))
    return parts.select("file", "at", F.concat(F.when(F.col("before") == 2, inside).otherwise(F.col("body")), F.lit("}"), F.when(F.col("after") == 2, "]}").otherwise("")).alias("value"))


def explode_parts(parts: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``explode_exports`` from document parts. A document with a part that cannot be read is dropped."""
    read = parts.select("file", "at", F.from_json("value", EXPORT_SCHEMA).alias("d"), F.json_object_keys("value").alias("keys"))
    fields = ["groupIds", "groupNames", "startUnix", "endUnix", "coveredFromUnix"]
    heads = read.groupBy("file").agg(*[F.first(f"d.{c}", ignorenulls=True).alias(c) for c in fields], F.max(F.coalesce(F.array_contains("keys", "coveredFromUnix"), F.lit(False))).alias("has_covered"),
                                     F.max(F.col("keys").isNull()).alias("bad")).filter("not bad and groupIds is not null")
    return explode_exports(read.join(heads.select("file"), "file", "left_semi"), heads.select("file", F.struct(*fields).alias("d"), "has_covered"))


def explode_exports(parsed: DataFrame, heads: DataFrame | None = None) -> dict[str, DataFrame]:
    """Text messages, media messages, media refs, quotes, scans and names of parsed exports.

    ``parsed`` may hold parts of documents: their ``at`` orders the elements, and ``heads`` has the documents' own fields.
    """
    if "at" not in parsed.columns:
        parsed = parsed.withColumn("at", F.lit(0).cast("long"))
    who = speaker("m.senderName", "m.memberName", "m.senderUin")
    text = parsed.select("file", "at", F.posexplode("d.messages").alias("pos", "m")).select(
        F.col("m.groupId").alias("group_id"), F.col("m.rowId").alias("row_id"), F.col("m.sentAt").alias("sent_at"), who.alias("speaker"), light_clean("m.text").alias("text"),
        F.coalesce("m.senderUin", F.lit("")).alias("speaker_uin"), F.lit(0).cast("long").alias("is_media"), F.lit("").alias("media_kinds"), "file", (F.col("at") + F.col("pos")).alias("input_order"))
    refs = F.transform("m.mediaRefs", lambda r: F.struct(r["source"].alias("source"), r["kind"].alias("kind"), r["extension"].alias("extension"), r["hash"].alias("hash"),
                                                       r["fileName"].alias("file_name"), r["localPath"].alias("local_path"), r["url"].alias("url")))
    shown = parsed.select("file", "at", F.posexplode("d.mediaMessages").alias("pos", "m")).withColumn("refs", F.coalesce(refs, F.array().cast(f"array<struct<{_typed(MEDIA_REF)}>>"))).withColumn(
        "t", media_text(F.col("refs"), F.coalesce("m.bodySnippet", F.lit(""))))
    media = shown.select(
        F.col("m.groupId").alias("group_id"), F.concat(F.lit("m"), F.col("m.rowId")).alias("row_id"), F.col("m.sentAt").alias("sent_at"), who.alias("speaker"), F.col("t.text").alias("text"),
        F.coalesce("m.senderUin", F.lit("")).alias("speaker_uin"), F.lit(1).cast("long").alias("is_media"), F.col("t.kinds").alias("media_kinds"), "file", (F.col("at") + F.col("pos")).alias("input_order"), "refs")
    each = media.select("group_id", F.expr("substring(row_id, 2)").alias("row_id"), "sent_at", F.col("speaker_uin").alias("sender"), "speaker", "file", "input_order", F.explode("refs").alias("r")).select("*", "r.*").drop("r")
    quotes = parsed.select(F.explode("d.quoteLinks").alias("q")).select(F.col("q.groupId").alias("group_id"), F.col("q.rowId").alias("row_id"), F.col("q.quotedImageHashes").alias("quoted_hashes"))
    heads = parsed if heads is None else heads
    scans = heads.select("file", F.explode("d.groupIds").alias("group_id"), F.col("d.startUnix").alias("start_unix"), F.col("d.endUnix").alias("end_unix"), F.col("d.coveredFromUnix").alias("covered_from"), "has_covered", F.col("file").alias("run_id"))
    names = heads.select("file", F.explode("d.groupIds").alias("group_id"), F.col("d.groupNames").alias("n"), F.col("d.endUnix").alias("seq")).select("group_id", F.coalesce(F.try_element_at("n", F.col("group_id")), F.lit("")).alias("name"), "seq")
    return {"text": text, "media": media.drop("refs"), "refs": each, "quotes": quotes, "scans": scans, "names": names}


def _typed(ddl: str) -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in ddl.split(", "))


def read_exports(spark: SparkSession, path: str, whole: int = WHOLE_BYTES) -> dict[str, DataFrame]:
    """All export documents of a folder: those up to ``whole`` bytes one per row, larger ones in splits."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # names and sizes, as Spark's own listing
    large = [r["path"] for r in sizes if r["length"] > whole]
    if not large:
        return explode_exports(parse_exports(export_documents(spark, path)))
    split = explode_parts(document_parts(spark, large))
    small = [r["path"] for r in sizes if r["length"] <= whole]
    if not small:
        return split
    rest = explode_exports(parse_exports(export_documents(spark, small)))
    return {name: table.unionByName(split[name]) for name, table in rest.items()}


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of all media manifests (``<runs>/<run id>/media/<file>``); corrupt files give none."""
    rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/media/[^/]+$", 1)
    return rows.select(run.alias("run_id"), *[F.col(f.name) for f in MANIFEST_SCHEMA])


def media_index_rows(manifest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Media index from manifest rows with a copied file; ``sizes``: copied_path, bytes."""
    kept = manifest.filter("copiedPath <> ''").join(sizes, F.col("copiedPath") == F.col("copied_path"))
    named = F.lower(F.element_at(F.split("copiedPath", r"[\\/]"), -1))
    has = F.coalesce(F.col("hash") != "", F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return kept.select("run_id", text("groupId").alias("group_id"), text("groupName").alias("group_name"), text("rowId").alias("row_id"), text("hkt").alias("hkt"), text("speaker").alias("speaker"),
                       F.coalesce("kind", F.lit("file")).alias("kind"), "bytes", F.col("copiedPath").alias("web_path"), F.when(has, F.col("hash")).otherwise(named).alias("content_key"), F.when(has, "hash").otherwise("filename").alias("content_key_source"))


def read_group_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("group_id string, name string").option("sep", "\t").csv(path)
    return rows.filter(F.trim("group_id").rlike("^[0-9]+$")).select(F.trim("group_id").alias("group_id"), F.coalesce("name", F.lit("")).alias("name"))


def read_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and MD5 of binary files; the digest is computed where the file is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def read_file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of files; their content is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_unix"))


def with_names(rows: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Member card (else nickname) and group name of raw rows."""
    shown = F.coalesce(F.nullif("card", F.lit("")), F.nullif("nickname", F.lit("")), F.lit(""))
    people = members.select("group_id", F.col("uid").alias("sender_uid"), shown.alias("member_name"))
    return rows.join(people, ["group_id", "sender_uid"], "left").join(groups.select("group_id", F.col("name").alias("group_name")), "group_id", "left").withColumn(
        "member_name", F.coalesce("member_name", F.lit(""))).withColumn("group_name", F.coalesce("group_name", F.lit("")))
