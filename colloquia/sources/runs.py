"""Reader of run folders: what each run scanned, analysed, summarised and copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquia.operators import runs as rn
from colloquia.sources.exports import MANIFEST_SCHEMA

_COVER = "struct<totalTextMessages:long,includedTextMessages:long>"
ANALYSIS = (f"groupIds array<string>, groupNames map<string,string>, byGroup array<array<string>>, parsedTextMessages long, parsedMediaMessages long, firstMessageHkt string, lastMessageHkt string, "
            f"topics array<struct<name:string,count:long>>, mediaSummary struct<refs:long>, llmSummary struct<summary:string,coverage:{_COVER}>")
DIGEST = "overview string, llmGroups long, groupCount long"
EXPORT = "groupIds array<string>, startUnix long, endUnix long, coveredFromUnix long"


def any_file(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def documents(spark: SparkSession, root: str, inside: str, schema: str | None) -> DataFrame:
    """(run_id, path, modified, value, d) of one kind of file in every run folder, ``d`` an object
    of ``schema`` or else a list of manifest rows; unreadable documents are left out."""
    pattern = f"{root}/*/{inside}"
    kind = T.ArrayType(MANIFEST_SCHEMA) if schema is None else T.StructType.fromDDL(schema)
    if not any_file(spark, pattern):
        return spark.createDataFrame([], T.StructType.fromDDL("run_id string, path string, modified long, value string").add("d", kind))
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/" + inside.replace(".", r"\.").replace("*", "[^/]*") + "$", 1)
    rows = spark.read.text(pattern, wholetext=True).select(
        run.alias("run_id"), F.col("_metadata.file_path").alias("path"), F.unix_timestamp("_metadata.file_modification_time").alias("modified"), "value")
    readable = F.json_array_length("value") if schema is None else F.json_object_keys("value")
    return rows.withColumn("d", F.from_json("value", kind)).filter(readable.isNotNull())


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Listing rows (see ``operators.runs.run_rows``) of all run folders below ``root``.

    A folder without a readable ``analysis/analysis.json`` is no run. A run with a digest takes
    its summary and its summary coverage from the digest and the analyses of its groups, others
    from their one analysis. A run without exports has an unknown scan coverage.
    """
    runs = documents(spark, root, "analysis/analysis.json", ANALYSIS)
    digests = documents(spark, root, "analysis/digest.json", DIGEST).select("run_id", "d.overview", F.lit(True).alias("has_digest"))
    each = documents(spark, root, "analysis/groups/*/analysis.json", ANALYSIS).join(digests.select("run_id"), "run_id", "left_semi")
    exports = documents(spark, root, "exports/*.json", EXPORT)
    media = documents(spark, root, "media/media-manifest.json", None)

    base = runs.select("run_id", F.coalesce("d.parsedTextMessages", F.lit(0)).alias("text_messages"), F.coalesce("d.parsedMediaMessages", F.lit(0)).alias("media_messages"),
                       F.col("modified").alias("modified_unix"), F.coalesce("d.groupIds", F.array().cast("array<string>")).alias("group_ids"))
    scan = rn.run_scan_coverage(exports.join(base.select("run_id"), "run_id", "left_semi").select(
        "run_id", F.col("d.startUnix").alias("start_unix"), F.col("d.endUnix").alias("end_unix"), F.size(F.coalesce("d.groupIds", F.array().cast("array<string>"))).alias("group_count"),
        F.col("d.coveredFromUnix").alias("covered_from"), F.array_contains(F.json_object_keys("value"), "coveredFromUnix").alias("has_covered")))
    single = runs.join(digests.select("run_id"), "run_id", "left_anti")
    cover = F.col("d.llmSummary.coverage")
    ai = rn.run_ai_coverage(single.select("run_id", "d").unionByName(each.select("run_id", "d")).select(
        "run_id", F.coalesce(cover["totalTextMessages"], F.col("d.parsedTextMessages"), F.lit(0)).alias("total"), cover["includedTextMessages"].alias("included"), F.col("d.llmSummary").isNotNull().alias("used")))
    counted = runs.select("run_id", F.explode("d.byGroup").alias("g")).select("run_id", F.col("g")[0].alias("name"), F.col("g")[1].cast("double").cast("long").alias("count"))
    named = rn.run_label(counted)
    plain = runs.select("run_id", F.nullif(F.array_join("d.groupIds", ", "), F.lit("")).alias("ids"))
    labels = plain.join(named, "run_id", "left").select("run_id", F.coalesce("groups", "ids").alias("groups"))
    topics = runs.select("run_id", F.explode("d.topics").alias("t")).select("run_id", "t.name", "t.count")
    stored = runs.join(digests, "run_id", "left").select("run_id", F.when(F.col("has_digest"), F.col("overview")).otherwise(F.col("d.llmSummary.summary")).alias("summary"))
    manifest = media.select("run_id", F.explode("d").alias("m")).select("run_id", F.col("m.copiedPath").alias("copied_path"), F.col("m.url").alias("url"))
    return rn.run_rows(base, scan, ai, rn.manifest_counters(manifest), labels, rn.run_summary(topics, stored))

