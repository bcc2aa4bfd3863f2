"""Alignment of two tokenizations of one text by the byte offsets where tokens of both end.

Every text becomes two id lists. The cumulative byte ends of each list are the keys of an
end-to-index dictionary; the intersection of both key sets, sorted, slices the two lists into
groups, and a group's last tokens, whose byte ranges end together, form a link. Corpus-wide
link counts then say how usual each link is.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquia.llm.common import durable, pick

FIELDS = "doc_id long, n_a long, n_b long, n_groups long, groups string, pair array<long>, times array<int>"
#: A pair that holds more than one in so many rows is joined by broadcast: at most so many pairs do.
HOT_SHARE = 1 << 20
_SIDE = 1 << 32
_loaded: dict[tuple[str, str, str], tuple] = {}


def tokenizer_files() -> tuple[str, str, str]:
    """Rank file of the byte-level vocabulary, its split pattern, and the piece model."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def _tokenizers(files: tuple[str, str, str]) -> tuple[Callable, list[bytes], Callable, list[bytes]]:
    """(text -> ids, bytes by id) of both tokenizers; the first one's special strings are plain text."""
    if files not in _loaded:
        import sentencepiece
        import tiktoken
        ranks, pattern, model = files
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        first = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        a_bytes = [b""] * (max(merges.values()) + 1)
        for token, rank in merges.items():
            a_bytes[rank] = token
        second = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [second.id_to_piece(i) for i in range(second.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        _loaded[files] = (lambda t: first.encode_to_numpy(t, disallowed_special=()).tolist()), a_bytes, second.encode, b_bytes
    return _loaded[files]


def slices(a_ends: list[int], b_ends: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Indices in a and in b of the tokens that end together, in order: each two close a group."""
    a_at, b_at = dict(zip(a_ends, range(len(a_ends)))), dict(zip(b_ends, range(len(b_ends))))
    ends = sorted(a_at.keys() & b_at.keys())
    return tuple(map(a_at.__getitem__, ends)), tuple(map(b_at.__getitem__, ends))


def align(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per document: token counts, its groups as ``a1,a2|b1;a3|b2,b3``, and its links.

    ``pair`` holds the distinct linked id pairs (a * 2^32 + b) and ``times`` how often each is
    linked. Null and empty texts, and texts that either tokenizer does not give back byte by
    byte, have no tokens: zeros, empty groups and no links. Repeated rows give repeated rows;
    other columns are ignored.
    """
    files = files or tokenizer_files()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_encode, a_bytes, b_encode, b_bytes = _tokenizers(files)
        a_size, b_size = np.array([len(t) for t in a_bytes]), np.array([len(t) for t in b_bytes])
        # the text of an id with the mark that follows it inside a group (first half) and at its end
        a_text = np.array([f"{i}," for i in range(len(a_bytes))] + [f"{i}|" for i in range(len(a_bytes))], object)
        b_text = np.array([f"{i}," for i in range(len(b_bytes))] + [f"{i};" for i in range(len(b_bytes))], object)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, row = text.as_py(), (doc_id, 0, 0, 0, "", [], [])
                if text:
                    a, b, wanted = a_encode(" " + text), b_encode(text), (" " + text).encode()
                    if b"".join(map(a_bytes.__getitem__, a)) == wanted == b"".join(map(b_bytes.__getitem__, b)):
                        a_id, b_id = np.array(a), np.array(b)
                        a_cut, b_cut = map(np.array, slices(np.cumsum(a_size[a_id]).tolist(), np.cumsum(b_size[b_id]).tolist()))
                        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
                        a_last[a_cut] = b_last[b_cut] = True
                        # group g stands behind all a tokens up to its end and all b tokens before it, and so on
                        marked = np.empty(len(a) + len(b), object)
                        marked[np.arange(len(a)) + np.concatenate([[0], b_cut + 1])[np.cumsum(a_last) - a_last]] = a_text[a_id + a_last * len(a_bytes)]
                        marked[np.arange(len(b)) + (a_cut + 1)[np.cumsum(b_last) - b_last]] = b_text[b_id + b_last * len(b_bytes)]
                        pair, times = np.unique(a_id[a_cut] * _SIDE + b_id[b_cut], return_counts=True)
                        row = (doc_id, len(a), len(b), len(a_cut), "".join(marked.tolist())[:-1], pair, times)
                out.append(row)
            columns = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "n_a", "n_b", "n_groups", "groups", "pair", "times"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(work, FIELDS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, count, n_rows, best): corpus-wide links of each pair, the documents that hold it, and whether
    no other pair of its b id is linked more often. A b id has at most as many pairs as there are a ids."""
    links = aligned.select(F.inline(F.arrays_zip("pair", "times")))
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("n_rows"))
    b = F.col("pair").bitwiseAND(F.lit(_SIDE - 1))
    return counts.select("pair", F.shiftright("pair", 32).alias("a"), b.alias("b"), "count", "n_rows",
                         (F.col("count") == F.max("count").over(Window.partitionBy(b))).alias("best"))


def usual_links(docs: DataFrame, files: tuple[str, str, str] | None = None, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``count_sum`` adds the corpus-wide counts of all links, ``n_best`` counts the links that no
    other pair of their b id beats. Texts are tokenised once; the slim links are checkpointed.
    Pairs in more than 1 of ``hot_share`` rows are joined by broadcast (there are fewer than
    ``hot_share`` of them), all others by a shuffle in which no key is hot.
    """
    found = align(docs, files)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    cut = durable(found.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pair", "times"))
    cut = cut.withColumn("_row", F.monotonically_increasing_id())
    counts = durable(pair_counts(cut).select("pair", "count", "best", "n_rows"))
    rows = counts.agg(F.sum("n_rows")).first()[0] or 0
    hot = counts.filter(F.col("n_rows") > rows / hot_share).drop("n_rows")
    rest = counts.filter(F.col("n_rows") <= rows / hot_share).drop("n_rows")
    links = cut.select("_row", F.inline(F.arrays_zip("pair", "times")))
    parts = [links.join(F.broadcast(hot), "pair")]
    if not rest.isEmpty():
        parts.append(links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest, "pair"))
    sums = [p.groupBy("_row").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")) for p in parts]
    total = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1]).groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return cut.drop("pair", "times").join(total, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
