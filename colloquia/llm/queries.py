"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquia.llm import alignment, language, mixing, neighbours, packing, quality, secrets, sharding, simhash, suffixes, toxicity, trie, urls
from colloquia.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function
    return register


@query("op2_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.hilbert_shards(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM rows GROUP BY source),
filling AS (
  SELECT *, (SELECT 1.5 * sum(source_size) FROM sources) AS budget, row_number() OVER w AS turn,
    coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources WINDOW w AS (ORDER BY 2.0 * source_size / weight, source)),
level AS (
  SELECT coalesce(max(level), 'infinity'::DOUBLE) AS level FROM (
    SELECT CAST(budget - capped AS DOUBLE) / open AS level FROM filling
    WHERE 2 * source_size > CAST(budget - capped AS DOUBLE) / open * weight ORDER BY turn LIMIT 1)),
targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= level * weight THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target
  FROM sources, level),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets),
ordered AS (
  SELECT r.doc_id, r.source, r.size, p.source_size, p.target, p.times, p.target - p.times * p.source_size AS part,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - sum(r.size) OVER (PARTITION BY r.source, r.key) AS before, sum(r.size) OVER (PARTITION BY r.source, r.key) AS here
  FROM rows r JOIN plan p ON p.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target,
  times + CASE WHEN part > 0 AND before < part AND 2 * before + here <= 2 * part THEN 1 ELSE 0 END AS copies,
  (times + CASE WHEN part > 0 AND before < part AND 2 * before + here <= 2 * part THEN 1 ELSE 0 END) * size AS taken
FROM ordered"""


@query("op6_water_filling_mix", MIX_SQL)
def water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op9_linear_grouping_pack")
def linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query("op10_simhash_blocks")
def simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_url_language_ratio")
def url_language_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


@query("op7_collision_neighbours")
def collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@query("op1_language_mixture")
def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, *language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", F.size("proportions").alias("n_langs"))


@query("op8_noisy_or_toxicity")
def noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, *toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").cast("int").alias("n_offending"))


@query("op3_ngram_ratio_rules")
def ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query("op4_prefix_free_spans")
def prefix_free_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.usual_links(read(spark, sf_dir, "documents"))


@query("op12_trigram_secrets")
def trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.listed(secrets.find_secrets(read(spark, sf_dir, "documents")))


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT conv_id, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), s -> [CAST(ascii(s) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    (crc, x) -> xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1)))) % 4 AS h FROM turns),
paths AS (
  SELECT c.conv_id, t.i AS place, t.role, t.text FROM ids c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i, t.role, t.text FROM ids c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM paths),
keyed AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(md5(role) || md5(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM keyed GROUP BY key),
rolled AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND starts_with(c.key, n.key)) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, 64 * (n.depth - 1))),
above AS (SELECT r.*, left(r.key, 64 * g.d) AS top FROM rolled r, LATERAL (SELECT unnest(generate_series(0, r.depth)) AS d) g),
sums AS (SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM above GROUP BY top),
lasts AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(key, depth) AS key FROM keyed GROUP BY conv_id) GROUP BY key)
SELECT r.conv_id, CAST(r.depth AS BIGINT) AS depth, r.parent_conv_id, CAST(r.n_convs AS BIGINT) AS n_convs, CAST(r.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM rolled r JOIN sums s ON s.top = r.key LEFT JOIN lasts l ON l.key = r.key"""


@query("op11_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))
