"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into buckets. Two multinomials over the buckets are
counted: one from trusted documents (labelled of good quality), one from the whole corpus. A
document's score is the mean log-likelihood ratio of its n-grams. The cut lies three times as
far below the median of the trusted documents' own scores as their 1 % quantile does; every
document is compared with it.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia.llm.common import GAP, durable, pick, whole, words

BUCKETS = 1 << 16
SMOOTHING = 0.5
DIGITS = 4  # of a bucket's weight; scores of good prose spread over some hundredths
QUANTILE, REACH = 0.01, 3.0
MIN_WORDS, REPEAT_PERCENT = 50, 50
MASK_ROWS = 1 << 17  # of 1,024 ids each: about 20 MB
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash, in one sort; texts without a repeated window stop
    after a sort of plain numbers.
    """
    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(places, lambda q: F.aggregate(F.transform(q, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(q, k + 1) - x), F.lit(3))), F.lit(0), lambda s, x: s + x))

    def of(hashes: Column) -> Column:
        some = let(F.sort_array(hashes), lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1)))
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(some, let(pairs, covered)).otherwise(F.lit(0))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, of))


def base_counts(text: Column, w: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(rf"\A({GAP})?\z"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w).cast("long"),
    }


def gram_buckets(w: Column, buckets: int) -> Column:
    """Bucket numbers of all words and word pairs."""
    mask = F.lit(buckets - 1).cast("long")
    one = F.transform(w, lambda x: F.xxhash64(x).bitwiseAND(mask).cast("int"))
    two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)).bitwiseAND(mask).cast("int")))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled of good quality."""
    return pick(labels, "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1 and doc_id is not null").select("doc_id")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target) of all documents; target is 1 where the id is trusted, else 0.

    Texts are not shuffled for it: ids become bits, 1,024 neighbours a row, and these rows are
    broadcast while there are at most ``MASK_ROWS`` of them. Ids that are no whole numbers, and more rows, join plainly.
    """
    rows, good = pick(docs, "doc_id", "text"), trusted_ids(labels)
    if all(f.dataType.typeName() in ("byte", "short", "integer", "long") for f in (rows.schema["doc_id"], good.schema["doc_id"])):
        at = F.col("doc_id").cast("long")
        cell, word = F.shiftright(at, 10), F.shiftright(at, 6).bitwiseAND(F.lit(15))
        mask = lambda i: F.coalesce(F.bit_or(F.when(word == i, F.expr("shiftleft(1L, cast(doc_id & 63 as int))"))), F.lit(0).cast("long"))
        masks = durable(good.groupBy(cell.alias("_cell")).agg(F.array(*[mask(i) for i in range(16)]).alias("_masks")))
        if masks.count() <= MASK_ROWS:
            hit = F.expr("shiftrightunsigned(_word, cast(doc_id & 63 as int)) & 1L")
            found = rows.withColumn("_cell", cell).join(F.broadcast(masks), "_cell", "left").withColumn("_word", F.get("_masks", word.cast("int")))
            return found.select("doc_id", "text", F.coalesce(hit, F.lit(0)).cast("long").alias("target"))
    return rows.join(good.withColumn("target", F.lit(1)), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(0)).cast("long").alias("target"))


def ratio_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> Column:
    """log p(bucket | trusted) - log p(bucket | corpus) as one array literal.

    Both sides count all n-grams of all their documents, summed map-side; only the fixed
    number of bucket sums comes to the driver.
    """
    grams = marked(docs, labels).select("target", F.explode(let(words(F.col("text")), lambda w: gram_buckets(w, buckets))).alias("bucket"))
    sums = durable(grams.groupBy("bucket").agg(F.sum("target").alias("target"), F.count(F.lit(1)).alias("raw")))
    total = sums.agg(F.coalesce(F.sum("target"), F.lit(0)).alias("target"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw")).first()
    share = lambda n, c: F.log((F.coalesce(c, F.lit(0)) + SMOOTHING) / F.lit(total[n] + SMOOTHING * buckets))
    every = docs.sparkSession.range(buckets).join(sums, F.col("id") == F.col("bucket"), "left")
    weights = every.select("id", F.round(share("target", F.col("target")) - share("raw", F.col("raw")), DIGITS).alias("weight"))
    # one string of a fixed number of weights, in bucket order; short numbers keep plans and tasks small
    text = weights.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "weight"))), lambda r: r["weight"].cast("string")), ",")).first()[0]
    return F.split(F.lit(text), ",").cast("array<double>")  # a constant: folded once, when the query is planned


def mean_ratio(w: Column, weights: Column, buckets: int) -> Column:
    total = let(gram_buckets(w, buckets), lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(weights, x)) / F.greatest(F.size(b), F.lit(1)))
    return F.coalesce(total, F.lit(0.0))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE) -> DataFrame:
    """All documents (columns kept in ``row``) with counts, score and verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.
    Null and empty texts have no word: all counts 0, score 0, base_failed. Without trusted
    documents both models are the corpus's smoothing, and the cut is minus infinity: only the
    base rules reject. Repeated rows are judged alike.
    """
    weights = ratio_weights(docs, labels, buckets)
    marks = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: marks[docs.columns.index(n)] for n in ("doc_id", "text")}
    flat = docs.toDF(*marks)
    counted = lambda w: F.struct(*[c.alias(n) for n, c in base_counts(whole(F.col(at["text"])), w).items()], mean_ratio(w, weights, buckets).alias("score"))
    stats = flat.select(F.struct(*marks).alias("row"), F.col(at["doc_id"]).alias("doc_id"), let(words(F.col(at["text"])), counted).alias("s"))
    failed = (F.col("s.n_words") < MIN_WORDS) | (100 * F.col("s.n_repeat_words") > REPEAT_PERCENT * F.col("s.n_words"))
    good = marked(docs, labels).filter("target = 1")
    cut = good.select(let(words(F.col("text")), lambda w: F.when(F.size(w) >= MIN_WORDS, mean_ratio(w, weights, buckets))).alias("score")).agg(
        F.percentile_approx("score", [quantile, 0.5], 100000)).first()[0]
    keep = F.col("s.score") >= F.lit(cut[1] - REACH * (cut[1] - cut[0]) if cut else float("-inf"))
    return stats.withColumn("base_failed", failed).select("row", "doc_id", "s.*", "base_failed", (~F.col("base_failed") & keep).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return judge(docs, labels, **options).filter("kept").select("row.*").toDF(*docs.columns)
