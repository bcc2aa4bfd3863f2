"""A stored inverted index of catalog tokens, laid out by token prefix and kept up by assets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquia.operators.catalog import f_text, search_parts, search_tokens
from colloquia.operators.upserts import replace_children
from colloquia.session import durable
from colloquia.sources.lake import KeyedTable, bucket_of

PREFIX = 2
POSTING, ASSET = "prefix string, token string, hash string", "hash string, tokens array<string>"


@dataclass(frozen=True)
class SearchIndex:
    """Postings by bucket of the first characters of a token, and the tokens of each asset.

    A search opens the buckets of its terms' prefixes. A re-parsed asset changes only the postings
    in which its old and new tokens differ.
    """
    path: str
    buckets: int = 256

    @property
    def postings(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/postings", ("prefix",), self.buckets)

    @property
    def assets(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/assets", ("hash",), self.buckets)

    def update(self, images: DataFrame, loras: DataFrame) -> list[int]:
        """Replace the tokens of these assets (all their ``loras`` rows included); returns the rewritten posting buckets.

        Running it again changes nothing, also after a failure between the two tables.
        """
        spark = images.sparkSession
        none, own = F.array().cast("array<string>"), images.select("hash").distinct()
        found = search_tokens(images, loras.join(own, "hash", "left_semi")).groupBy("hash").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
        fresh = durable(own.join(found, "hash", "left").select("hash", F.coalesce("tokens", none).alias("tokens")))
        stored = self.assets.part(spark, spark.createDataFrame([], ASSET), self.assets.touched(fresh))
        both = fresh.join(stored.withColumnRenamed("tokens", "old"), "hash", "left").withColumn("old", F.coalesce("old", none))
        changed = both.select("hash", F.explode(F.array_union(F.transform(F.array_except("tokens", "old"), lambda t: F.struct(t.alias("token"), F.lit(True).alias("added"))),
                                                              F.transform(F.array_except("old", "tokens"), lambda t: F.struct(t.alias("token"), F.lit(False).alias("added"))))).alias("c"))
        delta = changed.select(F.substring("c.token", 1, PREFIX).alias("prefix"), "c.token", "hash", "c.added")
        like = spark.createDataFrame([], POSTING)
        written = self.postings.upsert(delta, lambda old, new: old.join(new.select("token", "hash"), ["token", "hash"], "left_anti").select(like.columns).unionByName(
            new.filter("added").select(like.columns)), like)
        self.assets.upsert(fresh, lambda old, new: replace_children(old, new, new))
        return written

    def tokens(self, spark: SparkSession, query: str) -> DataFrame:
        """(hash, token) rows that can match the terms of ``query``. A term of one character may begin any prefix, so it reads all."""
        like, parts = spark.createDataFrame([], POSTING), search_parts(query)
        if any(len(p) < PREFIX for p in parts):
            return self.postings.read(spark, like).select("hash", "token")
        starts = spark.createDataFrame([(p[:PREFIX],) for p in parts], "prefix string")
        opened = sorted({r[0] for r in starts.select(bucket_of(("prefix",), self.buckets)).collect()})
        return self.postings.part(spark, like, opened).filter(F.col("prefix").isin([p[:PREFIX] for p in parts])).select("hash", "token")

    def search(self, images: DataFrame, query: str) -> DataFrame:
        return f_text(images, self.tokens(images.sparkSession, query), query)
