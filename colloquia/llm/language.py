"""Language identification by multilingual mixture inference.

A document's letter n-grams are drawn from a mixture of language profiles. Expectation
maximisation finds the proportions; languages are dropped while the penalised likelihood
rises. The prediction is the language with the largest proportion in the selected set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia.llm.common import pick, whole

SAMPLE = 3000  # expected number of training documents per language
BUCKETS = 1 << 14
SMOOTHING = 0.5
ROUNDS, PENALTY = 30, 2.0
PIECE = 1 << 20  # characters counted at once
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed letter bigrams and trigrams of a whole text (runs of other characters count as one space); None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + 2]
        two = part[:-1] * np.uint32(0x9E3779B1) + part[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + part[2:]
        two = two[: min(PIECE, len(codes) - 1 - at)]
        for hashed, salt in ((two, 0x27D4EB2F), (three, 0x165667B1)):
            out += np.bincount(((hashed ^ (hashed >> np.uint32(15))) * np.uint32(salt)) >> np.uint32(18), minlength=BUCKETS)
    return out


def proportions(grams: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM for the mixture weights of the given profiles (languages, grams), and the log-likelihood."""
    share = np.full(len(grams), 1 / len(grams))
    total = counts.sum()
    for _ in range(rounds if len(grams) > 1 else 0):
        mixed = share @ grams
        new = share * (grams @ (counts / mixed)) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(counts @ np.log(share @ grams))


def infer(profiles: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> dict[int, float]:
    """Selected languages and their proportions: drop the smallest while the penalised likelihood does not fall."""
    seen = np.flatnonzero(counts)
    grams, counts = profiles[:, seen], counts[seen].astype(float)
    chosen = np.arange(len(profiles))
    share, fit = proportions(grams, counts, rounds)
    cost = penalty * np.log(counts.sum() + 1)
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), np.argmin(share))
        new_share, new_fit = proportions(grams[chosen[rest]], counts, rounds)
        if new_fit + cost < fit:
            break
        chosen, share, fit = chosen[rest], new_share, new_fit
    return dict(zip(chosen.tolist(), share.tolist()))


def held_out(doc_id, folds: int, fold: int):
    return F.crc32(F.encode(whole(doc_id.cast("string")), "UTF-8")) % folds == fold


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their gram profiles, from about ``sample`` labelled documents per language.

    Which documents are taken depends only on a hash of id and text. Counting is distributed;
    languages x 2^14 sums come to the driver.
    """
    rows = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return [], np.empty((0, BUCKETS))
    at_most = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1, sample / n) * (1 << 31)))])
    taken = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) <= at_most[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                found = gram_counts(text.as_py())
                if found is not None:
                    sums[lang] = sums.get(lang, 0) + found
        for lang, total in sums.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit), pa.array(total[hit])], ["lang", "gram", "n"])

    langs = sorted(sizes)
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    sums = taken.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    if got.num_rows:
        row = np.searchsorted(np.array(langs), np.array(got["lang"].to_pylist()))
        table[row, got["gram"].to_numpy()] += got["n"].to_numpy()
    return langs, table / table.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, langs: list[str], profiles: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (proportion of that language) and all selected proportions of every document.

    Null, empty and letterless texts are ``und`` with score 0, as is everything when no
    language was learned. Ties go to the language first by name.
    """
    kind = "doc_id long, lang_pred string, score double, proportions map<string,double>"
    model = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x 2^14 numbers

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                counts = gram_counts(text.as_py()) if langs else None
                shares = infer(model.value, counts) if counts is not None else {}
                best = max(shares, key=lambda i: (shares[i], -i), default=None)
                rows.append((UNKNOWN, 0.0, []) if best is None else (langs[best], min(1.0, shares[best]), [(langs[i], s) for i, s in shares.items()]))
            preds, scores, maps = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                                             ["doc_id", "lang_pred", "score", "proportions"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, kind)
