"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models are counted from the URLs that the rules accept and
reject. A character is predicted from its longest context seen in that class, blended with
all shorter ones (Witten-Bell weights). A URL's score is the mean log-likelihood difference
per character, compared with a threshold calibrated on the URLs the rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from colloquia.llm.common import durable, pick, whole

ORDER = 4
ALPHABET = 1114112  # code points; the uniform end of every backoff chain
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
START, END = "\x02", "\x03"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty without ``://``."""
    at = F.instr(whole(url), "://")
    rest = F.when(at > 0, F.substr(whole(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (null if none fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """Log-likelihood difference of the last character of every gram, both models.

    ``grams`` has one row per distinct gram (``order`` context characters and the predicted
    one) with its counts in the two classes, 0 for grams met only elsewhere. Shorter contexts
    are sums over these rows; every table has at most one row per distinct gram.
    """
    def level(k: int) -> DataFrame:
        gram = F.expr(f"right(gram, {k + 1})")
        counts = grams.groupBy(gram.alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        around = F.expr(f"left(g, {k})")
        context = counts.groupBy(around.alias("around")).agg(*[
            e.alias(n + c) for c in ("good", "bad") for n, e in (("n_", F.sum(c)), ("t_", F.count(F.when(F.col(c) > 0, 1))))])
        return counts.withColumn("around", around).join(context, "around").drop("around")

    below = None
    for k in range(order + 1):
        now = level(k)
        if below is None:
            now = now.withColumns({"p_good": F.lit(1.0 / ALPHABET), "p_bad": F.lit(1.0 / ALPHABET)})
        else:
            now = now.withColumn("shorter", F.expr(f"right(g, {k})")).join(below, "shorter").drop("shorter")
        blend = lambda c: F.when(F.col("n_" + c) > 0, (F.col(c) + F.col("t_" + c) * F.col("p_" + c)) / (F.col("n_" + c) + F.col("t_" + c))).otherwise(F.col("p_" + c))
        below = now.select(F.col("g").alias("shorter"), blend("good").alias("p_good"), blend("bad").alias("p_bad"))
    return below.select(F.col("shorter").alias("gram"), (F.log("p_good") - F.log("p_bad")).alias("gain"))


def threshold(scored: DataFrame) -> float:
    """The cut with the least sum of both error rates on rule-decided URLs, in steps of 0.01; 0 without both classes."""
    bins = scored.filter("verdict is not null").groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("rows")).otherwise(0)).alias("good"), F.sum(F.when(F.col("verdict") == "block", F.col("rows")).otherwise(0)).alias("bad"))
    up, all_rows = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()  # a few thousand bins at most: scores are bounded logs
    error = F.coalesce(F.sum("good").over(up), F.lit(0)) / F.sum("good").over(all_rows) + 1 - F.coalesce(F.sum("bad").over(up), F.lit(0)) / F.sum("bad").over(all_rows)
    best = bins.withColumn("error", error).filter("error is not null").orderBy("error", F.abs("bin")).first()
    return best["bin"] / 100 if best else 0.0


def judge(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """Host, path, rule, score and verdict of every page.

    Null urls and urls without ``://`` have empty host and path, no rule and score 0. Scores
    belong to distinct URLs, so repeated pages and one very common host cost no more; equal
    pages get equal verdicts. With only one class of rule-decided URLs, the other model is
    uniform and the threshold 0. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pick(pages, "page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": name, "verdict": verdict})
    urls = durable(rows.filter("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("rows"), F.first("verdict").alias("verdict")))
    spots = urls.withColumn("chars", F.split(F.concat(F.lit(START * order), lower_ascii(F.col("url")), F.lit(END)), ""))
    places = F.sequence(F.lit(1), F.size("chars") - order)
    spots = spots.select("url", "rows", "verdict", F.explode(F.transform(places, lambda i: F.array_join(F.slice("chars", i, order + 1), ""))).alias("gram"))
    sums = [F.sum(F.when(F.col("verdict") == v, F.col("rows")).otherwise(0)).alias(c) for v, c in (("allow", "good"), ("block", "bad"))]
    gains = gram_scores(durable(spots.groupBy("gram").agg(*sums)), order)
    scores = spots.select("url", "gram").join(gains, "gram").groupBy("url").agg(F.avg("gain").alias("score"))
    scored = durable(urls.join(scores, "url"))
    cut = F.lit(threshold(scored))
    judged = scored.select(F.col("url").alias("of"), "score")
    out = rows.join(judged, rows["url"] == judged["of"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")
