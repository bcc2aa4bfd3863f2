"""Toxicity by multiple-instance learning.

A document is toxic if one of its sentences is: sentence probabilities are combined by
noisy-or, and the word weights are trained from document labels only. The same sentence
probabilities then locate the offending sentences. Length says nothing: a sentence without a
marking word, or with faint ones only, is harmless for certain, and a document's sentences that hold the same marking
words count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia.llm.common import durable, pick
from colloquia.llm.language import held_out

SAMPLE = 2500  # expected number of training documents per label value
PREFIXES = (5, 6, 7, 8)
MIN_DOCS, ODDS, SURE = 3, 1.0, 3.0  # a marking word: toxic sample documents, log odds, standard errors
STEPS, RATE, DECAY, BIAS, FLOOR = 250, 0.3, 0.02, -7.0, 0.02  # FLOOR bounds the pull of a document no word of which is known yet
OFFENDING = 0.3
LEAST = -2.0  # log odds of a sentence that count at all: faint doubts about many sentences do not add up to a toxic document
PIECE = 1 << 22  # bytes read at once; pieces end at a sentence end where there is one


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: lower case, word character (ASCII letter, digit or part of a longer character), sentence end; powers for word hashes."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    end = np.zeros(256, bool)
    end[[10, 33, 46, 63]] = True
    power = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
    return low, word, end, power


def sentence_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a text, the sentence number of each word, and where sentences end (bytes).

    One row per word: the whole word, then its prefixes of 5 to 8 bytes (0 where the word is
    not longer), so that unseen forms of a known stem are recognised.
    """
    low, is_word, is_end, power = tables()
    inside = is_word[data]
    ends = np.flatnonzero(is_end[data]) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.empty((0, 1 + len(PREFIXES)), np.uint64), np.empty(0, np.int64), ends
    spots = np.flatnonzero(inside)
    first = np.searchsorted(spots, starts)
    length = np.diff(np.append(first, len(spots)))
    place = np.arange(len(spots)) - np.repeat(first, length)
    upto = np.concatenate([[np.uint64(0)], np.cumsum((low[data[spots]].astype(np.uint64) + np.uint64(1)) * power[place & 1023])])
    parts = [upto[first + length] - upto[first]]
    for k in PREFIXES:
        longer = length > k
        parts.append(np.where(longer, (upto[np.where(longer, first + k, first)] - upto[first]) ^ np.uint64(k), np.uint64(0)))
    hashes = np.column_stack(parts)
    hashes ^= hashes >> np.uint64(29)
    return hashes * np.uint64(0xBF58476D1CE4E5B9), np.searchsorted(ends, starts, side="right"), ends


def pieces(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data):
            cut = np.flatnonzero(tables()[2][data[at:stop]])
            stop = at + int(cut[-1]) + 1 if len(cut) else stop
        yield at, data[at:stop]
        at = stop


def clean_log(z: np.ndarray, least: float = BIAS) -> np.ndarray:
    """Logarithm of the probability that a sentence is harmless: 0 where its words do not lift it above ``least``."""
    return np.minimum(0, np.logaddexp(0, least) - np.logaddexp(0, z))


def alike(sentence: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """A number per sentence that tells sets of marking words apart."""
    mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = np.zeros(n, np.uint64)
    np.add.at(keys, sentence, mixed ^ (mixed >> np.uint64(29)))
    return keys


def train(word: np.ndarray, sentence: np.ndarray, of: np.ndarray, label: np.ndarray, vocabulary: int) -> np.ndarray:
    """Gradient ascent on the noisy-or likelihood. word/sentence: pairs; of: document of each sentence."""
    weight, memory = np.zeros(vocabulary), np.full(vocabulary, 1e-8)
    for _ in range(STEPS):
        z = BIAS + np.bincount(sentence, weights=weight[word], minlength=len(of))
        doc = np.clip(-np.expm1(np.bincount(of, weights=clean_log(z), minlength=len(label))), FLOOR, 1 - 1e-6)
        pull = np.where(label[of] == 1, (1 - doc[of]) / doc[of], -1.0) / (1 + np.exp(-np.clip(z, -30, 30)))
        pull[z < BIAS] = 0  # derivative of the log-likelihood by z
        slope = np.bincount(word, weights=pull[sentence], minlength=vocabulary) - DECAY * weight
        memory += slope * slope
        weight += RATE * slope / np.sqrt(memory)
    return weight


def matches(hashes: np.ndarray, known: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in ``known``) of every known word or prefix; ``maybe`` marks the first 20 bits of known ones."""
    row, kind = np.nonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
    found = hashes[row, kind]
    spot = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
    same = known[spot] == found if len(known) else np.zeros(len(found), bool)
    return row[same], spot[same]


def first_bits(known: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 20, bool)
    maybe[(known >> np.uint64(44)).astype(np.int64)] = True
    return maybe


def text_features(text: str | None, known: np.ndarray, maybe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: (sentence, known feature) pairs of the sentences that hold one, each pair
    once and sentences numbered anew, then where these sentences begin and end in the text."""
    for at, data in pieces(text):
        hashes, number, ends = sentence_words(data)
        row, spot = matches(hashes, known, maybe)
        pair = np.unique(np.stack([number[row], spot]), axis=1)
        held, sentence = np.unique(pair[0], return_inverse=True)
        begin = np.concatenate([[0], ends[:-1]])
        yield sentence, pair[1], at + begin[held], at + ends[held]


def vocabulary(chosen: DataFrame) -> np.ndarray:
    """Sorted hashes of the words and prefixes that mark toxic sample documents, and of all sample
    words under a marking prefix (so that training can excuse harmless forms)."""
    names = ["word"] + [f"p{k}" for k in PREFIXES]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = [sentence_words(data)[0] for _, data in pieces(text.as_py())]
                if words:
                    rows = np.unique(np.concatenate(words), axis=0)
                    prefixes = np.unique(rows[:, 1:])
                    prefixes = prefixes[prefixes != 0]
                    alone = np.zeros((len(prefixes), rows.shape[1]), np.uint64)
                    alone[:, 0] = prefixes
                    every = np.concatenate([rows, alone]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in every.T] + [pa.array(np.full(len(every), toxic, np.int64))], [*names, "toxic"])

    kind = ", ".join(f"{n} long" for n in [*names, "toxic"])
    sizes = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad, good = sizes["bad"] + 1.0, sizes["all"] - sizes["bad"] + 1.0
    table = durable(chosen.mapInArrow(count, kind).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("docs"), *[F.max(n).alias(n) for n in names[1:]]))
    rate, other = (F.col("bad") + 0.5) / bad, (F.col("docs") - F.col("bad") + 0.5) / good
    both = F.col("docs") / (bad + good)
    marking = table.filter((F.col("bad") >= MIN_DOCS) & (F.log(rate) - F.log(other) > ODDS) & (rate - other > SURE * F.sqrt(both * (1 - both) * (1 / bad + 1 / good)))).select("word")
    under = table.select("word", F.explode(F.array(*names[1:])).alias("prefix")).join(marking.withColumnRenamed("word", "prefix"), "prefix", "left_semi").select("word")
    return np.sort(marking.union(under).distinct().toArrow()["word"].to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their weights, from about ``sample`` documents per label value.

    The sample depends only on a hash of the id. Words are counted and selected in Spark; only
    the places of selected words in sample documents come to the driver.
    """
    marked = pick(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return np.empty(0, np.uint64), np.empty(0)
    limit = lambda t: F.lit(int(min(1, sample / max(1, sizes.get(t, 0))) * (1 << 31)))
    taken = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) <= F.when(F.col("toxic") == 1, limit(1)).otherwise(limit(0)))
    chosen = durable(pick(docs, "doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "toxic"))  # about 2 * sample rows
    known = vocabulary(chosen)
    maybe = first_bits(known)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen: dict[int, list[int]] = {}
                for sentence, feature, begin, _ in text_features(text.as_py(), known, maybe):
                    keys, bounds = alike(sentence, feature, len(begin)), np.searchsorted(sentence, np.arange(len(begin) + 1))
                    for i in np.unique(keys, return_index=True)[1].tolist():
                        seen.setdefault(int(keys[i]), feature[bounds[i]:bounds[i + 1]].tolist())
                rows.append((sorted(seen.values()), toxic))
            cols = list(zip(*rows)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(pa.list_(pa.int64()))), pa.array(cols[1], pa.int64())], ["sentences", "toxic"])

    got = chosen.mapInArrow(places, "sentences array<array<long>>, toxic long").filter(F.size("sentences") > 0).orderBy("toxic", F.xxhash64("sentences")).toArrow()
    sentences = [(doc, features) for doc, each in enumerate(got["sentences"].to_pylist()) for features in each]
    if not sentences:
        return known[:0], np.empty(0)
    word = np.concatenate([np.asarray(f, np.int64) for _, f in sentences])
    number = np.repeat(np.arange(len(sentences)), [len(f) for _, f in sentences])
    return known, train(word, number, np.array([d for d, _ in sentences]), got["toxic"].to_numpy(), len(known))


def score(docs: DataFrame, known: np.ndarray, weight: np.ndarray) -> DataFrame:
    """doc_id, score and the offending sentences (byte range in the UTF-8 text, probability) of every document.

    Null and empty texts have no sentence, so their score is 0, like that of any text without a
    marking word, however long. Long texts are read piece by piece; the score is of the whole text.
    """
    kind = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"
    model = docs.sparkSession.sparkContext.broadcast((known, weight))  # words of the bounded sample
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = model.value
        maybe = first_bits(known)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                clean, bad, seen = 0.0, [], set()
                for sentence, feature, begin, end in text_features(text.as_py(), known, maybe):
                    z = BIAS + np.bincount(sentence, weights=weight[feature], minlength=len(begin))
                    log, keys = clean_log(z, LEAST), alike(sentence, feature, len(begin)).tolist()
                    for i in np.flatnonzero(log < 0).tolist():
                        clean += 0 if keys[i] in seen else log[i]
                        seen.add(keys[i])
                    p = -np.expm1(log)
                    bad += [{"start": int(begin[i]), "end": int(end[i]), "score": float(p[i])} for i in np.flatnonzero(p >= OFFENDING)]
                scores.append(float(-np.expm1(clean)))
                found.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, spans)], ["doc_id", "score", "offending"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, kind)
