"""Duplicate spans across documents by prefix-free parsing.

Texts are cut into phrases at rolling-hash triggers (see ``phrases``). Only a small part of the
corpus has to meet in sorted order: first the triggers that occur more than once are found,
then the distinct phrases at those triggers form dictionaries, one per range of triggers.
Where a trigger has several phrases, the suffixes of the dictionary are sorted (to the length
of a span, which never leaves its phrase), and equal suffixes stand side by side in corpus
order with the smallest doc_id among them. Each text's parse (its sequence of phrases) then
maps the dictionary's answers back to its own bytes.

Texts travel in blocks of bounded size, dictionaries in buckets of triggers. Inside a block a
phrase is sent once, however many copies the block holds, so a passage shared by a third of
all documents costs one entry a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquia.llm.common import pick, whole
from colloquia.llm.phrases import SPAN, Phrases, mix, parse

BLOCK_BYTES = 6 << 20
LAST = np.iinfo(np.int64).max  # stands for a missing doc_id: larger than every other


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, equal bytes of the numbers together."""
    plane = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(plane).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(dtype)


def joined(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a block as one byte array, and where each ends."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)


def block_phrases(data: np.ndarray, ends: np.ndarray) -> Phrases:
    found = list(parse(data, ends))
    none = Phrases(*[np.empty(0, np.int64)] * 3, *[np.empty(0, np.uint64)] * 2)
    return Phrases(*[np.concatenate(c) for c in zip(*found)]) if found else none


def doc_ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([LAST if v is None else v for v in column.to_pylist()], np.int64)


def address(trigger: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (trigger >> np.uint64(32)).astype(np.int64) % buckets, trigger.astype(np.uint32)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted array."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def table(kind: str, *columns) -> pa.Table:
    fields = [f.split() for f in kind.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    return pa.table([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


TRIGGERS = "bucket long, block long, n long, triggers binary"


def send_triggers(block: pa.Table, buckets: int) -> pa.Table:
    """The block's distinct triggers, by bucket."""
    data, ends = joined(block["text"])
    bucket, value = address(block_phrases(data, ends).trigger, buckets)
    both = np.unique((bucket.astype(np.uint64) << np.uint64(32)) | value)
    bucket, value = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
    at = runs(bucket)
    n = np.diff(np.r_[at, len(bucket)])
    number = block["block"][0].as_py()
    return table(TRIGGERS, bucket[at], [number] * len(at), n, [packed(np.diff(value[s : s + k], prepend=np.uint32(0))) for s, k in zip(at, n)])


def repeated_triggers(bucket: pa.Table) -> pa.Table:
    """For each block, those of its triggers that some other block has too."""
    counts, blobs = bucket["n"].to_pylist(), bucket["triggers"].to_pylist()
    each = [np.cumsum(unpacked(b, np.uint32, n), dtype=np.uint32) for b, n in zip(blobs, counts)]
    values, times = np.unique(np.concatenate(each), return_counts=True)
    again = values[times > 1]
    kept = [e[np.isin(e, again, assume_unique=True)] for e in each]
    rows = [(b, block, len(k), packed(np.diff(k, prepend=np.uint32(0)))) for b, block, k in zip(bucket["bucket"].to_pylist(), bucket["block"].to_pylist(), kept) if len(k)]
    return table(TRIGGERS, *(zip(*rows) if rows else [[]] * 4))


DICTIONARY = "bucket long, block long, n long, size long, starts binary, least binary, most binary, triggers binary, marks binary, bytes binary"


def send_phrases(block: pa.Table, repeated: pa.Table, buckets: int) -> pa.Table:
    """The block's distinct phrases at repeated triggers, with the smallest and largest doc_id that has them."""
    if not block.num_rows:
        return table(DICTIONARY, *[[]] * 10)
    data, ends = joined(block["text"])
    found = block_phrases(data, ends)
    doc = np.searchsorted(ends, found.start, side="right")
    known = np.sort(np.concatenate([np.empty(0, np.uint64)] + [
        (np.uint64(b) << np.uint64(32)) | np.cumsum(unpacked(blob, np.uint32, n), dtype=np.uint32).astype(np.uint64)
        for b, n, blob in zip(repeated["bucket"].to_pylist(), repeated["n"].to_pylist(), repeated["triggers"].to_pylist())]))
    bucket, value = address(found.trigger, buckets)
    key = (bucket.astype(np.uint64) << np.uint64(32)) | value
    order = np.argsort(key, kind="stable")
    at = runs(key[order])
    here = np.zeros(len(key), bool)  # also triggers met twice inside the block
    here[order] = np.repeat(np.diff(np.r_[at, len(key)]) > 1, np.diff(np.r_[at, len(key)]))
    if len(known):
        spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
        here |= known[spot] == key
    rows = np.flatnonzero(here)
    rows = rows[np.lexsort((found.mark[rows], found.trigger[rows], bucket[rows]))]
    name = mix(found.trigger[rows], found.mark[rows])
    at = runs(name)
    if not len(at):
        return table(DICTIONARY, *[[]] * 10)
    ids = doc_ids(block["doc_id"])[doc[rows]]
    least, most, first = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at), rows[at]
    cuts = runs(bucket[first])
    out = []
    for s, e in zip(cuts, np.r_[cuts[1:], len(first)]):
        part = first[s:e]
        length = found.spans[part] + SPAN - 1
        stop = np.cumsum(length)
        places = np.arange(stop[-1]) + np.repeat(found.start[part] - (stop - length), length)
        heads = (found.spans[part] << 8 | found.offset[part]).astype(np.uint16)
        out.append((int(bucket[part[0]]), e - s, int(stop[-1]), packed(heads), packed(least[s:e]), packed(most[s:e]), packed(found.trigger[part]), packed(found.mark[part]),
                    pa.compress(data[places].tobytes(), codec="zstd", asbytes=True)))
    b, n, size, *blobs = zip(*out)
    return table(DICTIONARY, b, [block["block"][0].as_py()] * len(out), n, size, *blobs)


def sorted_spans(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, to the length of a span: the order of the spans at ``start``, and where a new one begins in it."""
    words = []
    for at in range(0, SPAN, 8):  # eight bytes a number, first byte highest
        word = np.zeros(len(start), np.uint64)
        for i in range(at, min(at + 8, SPAN)):
            word = (word << np.uint64(8)) | data[start + i]
        words.append(word)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for word in words:
        ranked = word[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, new


ANSWERS = "block long, n long, names binary, least binary, first binary, last binary"


def answer_bucket(bucket: pa.Table) -> pa.Table:
    """For each block and phrase of it, the smallest doc_id in the corpus of every span, as runs of spans."""
    rows = bucket.to_pylist()
    counts = np.array([r["n"] for r in rows])
    part = lambda c, dtype: np.concatenate([unpacked(r[c], dtype, r["n"]) for r in rows])
    heads = part("starts", np.uint16).astype(np.int64)
    spans, least, most = heads >> 8, part("least", np.int64), part("most", np.int64)
    trigger, mark = part("triggers", np.uint64), part("marks", np.uint64)
    data = np.frombuffer(b"".join(pa.decompress(r["bytes"], decompressed_size=r["size"], codec="zstd", asbytes=True) for r in rows), np.uint8)
    begin = np.concatenate([[0], np.cumsum(spans + SPAN - 1)[:-1]]).astype(np.int64)
    order = np.lexsort((mark, trigger))
    new_phrase = np.r_[True, (mark[order][1:] != mark[order][:-1]) | (trigger[order][1:] != trigger[order][:-1])]
    phrase = np.empty(len(order), np.int64)
    phrase[order] = np.cumsum(new_phrase) - 1
    first = order[np.flatnonzero(new_phrase)]  # one copy of every distinct phrase
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(new_phrase))
    at = runs(trigger[first])
    alone = np.repeat(np.diff(np.r_[at, len(first)]) == 1, np.diff(np.r_[at, len(first)]))
    # pieces: phrase, first span, last span, smallest doc_id
    pieces = [(np.flatnonzero(alone), np.zeros(alone.sum(), np.int64), spans[first[alone]] - 1, smallest[alone])]
    mixed = np.flatnonzero(~alone)
    if len(mixed):
        n = spans[first[mixed]]
        of = np.repeat(mixed, n)
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rank, new = sorted_spans(data, begin[first[of]] + number)
        group = np.cumsum(new) - 1
        value = np.empty(len(of), np.int64)
        value[rank] = np.minimum.reduceat(smallest[of[rank]], np.flatnonzero(new))[group]
        cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (value[1:] != value[:-1])])
        pieces.append((of[cut], number[cut], number[np.r_[cut[1:], len(of)] - 1], value[cut]))
    of, low, high, value = (np.concatenate(c) for c in zip(*pieces))
    by = np.argsort(of, kind="stable")
    of, low, high, value = of[by], low[by], high[by], value[by]
    start, stop = np.searchsorted(of, phrase), np.searchsorted(of, phrase, side="right")
    name, number = mix(trigger, mark), np.repeat(np.arange(len(rows)), counts)
    out = []
    for r, row in enumerate(rows):
        mine = np.flatnonzero(number == r)
        times = stop[mine] - start[mine]
        entry = np.repeat(mine, times)
        piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + start[entry]
        use = value[piece] < most[entry]  # else no document of the block has a smaller one before it
        entry, piece = entry[use], piece[use]
        if len(entry):
            out.append((row["block"], len(entry), packed(name[entry]), packed(value[piece]), packed(low[piece].astype(np.uint8)), packed(high[piece].astype(np.uint8))))
    return table(ANSWERS, *(zip(*out) if out else [[]] * 6))


def removed_bytes(block: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the block's texts, where each text ends, and which bytes go."""
    data, ends = joined(block["text"])
    gone = np.zeros(len(data), bool)
    if not answers.num_rows:
        return data, ends, gone
    part = lambda c, dtype: np.concatenate([unpacked(b, dtype, n) for b, n in zip(answers[c].to_pylist(), answers["n"].to_pylist())])
    name, least, low, high = part("names", np.uint64), part("least", np.int64), part("first", np.uint8).astype(np.int64), part("last", np.uint8).astype(np.int64)
    order = np.argsort(name, kind="stable")
    name, least, low, high = name[order], least[order], low[order], high[order]
    found = block_phrases(data, ends)
    own = mix(found.trigger, found.mark)
    start, stop = np.searchsorted(name, own), np.searchsorted(name, own, side="right")
    times = stop - start
    entry = np.repeat(np.arange(len(own)), times)
    piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + start[entry]
    ids = doc_ids(block["doc_id"])[np.searchsorted(ends, found.start[entry], side="right")]
    entry, piece = entry[least[piece] < ids], piece[least[piece] < ids]
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, found.start[entry] + low[piece], 1)
    np.add.at(change, found.start[entry] + high[piece] + SPAN, -1)
    return data, ends, np.cumsum(change[:-1]) > 0


def cover(docs: DataFrame, finish, kind: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Run the three exchanges and hand each block with its removed bytes to ``finish``."""
    text = whole(F.col("text"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-total // min(block_bytes, max(1 << 20, total // (4 * cores)))))
    buckets = blocks
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    by_block = placed.groupBy("block")
    triggers = by_block.applyInArrow(lambda t: send_triggers(t, buckets), TRIGGERS)
    again = triggers.groupBy("bucket").applyInArrow(repeated_triggers, TRIGGERS)
    phrases = by_block.cogroup(again.groupBy("block")).applyInArrow(lambda t, r: send_phrases(t, r, buckets), DICTIONARY)
    answers = phrases.groupBy("bucket").applyInArrow(answer_bucket, ANSWERS)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: finish(t, *removed_bytes(t, a)), kind)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document what goes: bytes of any 50-byte string that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the SHA-256 of the
    remaining bytes. Null and empty texts have no bytes. Documents with one doc_id never take
    from each other; a missing doc_id counts as larger than all. Repeated rows are judged
    alike. An empty table gives no rows.
    """
    def finish(block: pa.Table, data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> pa.Table:
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out = []
        for doc_id, s, e in zip(block["doc_id"].to_pylist(), starts, ends):
            here = gone[s:e]
            spans = int(np.count_nonzero(here[1:] & ~here[:-1]) + (here[0] if len(here) else 0))
            out.append((doc_id, int(e - s), int(np.count_nonzero(here)), spans, hashlib.sha256(data[s:e][~here].tobytes()).hexdigest()))
        ids, size, removed, spans, sha = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cover(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), finish, DIGEST, block_bytes)


def deduplicated(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those bytes; characters cut in two go whole. ``n_chars``, where present, follows the text."""
    marks = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*marks)
    at = {n: marks[docs.columns.index(n)] for n in docs.columns}
    wide = flat.select(F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).alias("text"), *[m for m in marks if m != at["text"]])
    order = ["doc_id", "text", *[m for m in marks if m != at["text"]]]

    def finish(block: pa.Table, data: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> pa.Table:
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        texts = [None if t is None else data[s:e][~gone[s:e]].tobytes().decode("utf-8", "ignore") for t, s, e in zip(block["text"].to_pylist(), starts, ends)]
        return block.select(order).set_column(1, "text", pa.array(texts, pa.string()))

    kind = T.StructType([wide.schema[n] for n in order])
    out = cover(wide, finish, kind, block_bytes)
    named = {n: F.col("text") if m == at["text"] else F.col(m) for n, m in at.items()}
    if "n_chars" in named:
        named["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[named[n].alias(n) for n in docs.columns])
