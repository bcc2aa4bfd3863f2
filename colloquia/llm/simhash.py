"""SimHash near-duplicates: pigeonhole blocks, then verified Hamming distances.

Two settings share the code. With 64 bits and 3 differing bits at most, at least 2 of 5 blocks
are untouched, so each pair meets under one of the ten pairs of blocks. A shingle similarity
of 0.8 moves about 15 % of the bits, beyond any useful pigeonhole on 64 bits; there pairs meet
under one of 24 keys of six minima each of the shingle hashes (0.999 at the border, closer pairs
more surely), 512 bits select the candidates, out to three standard deviations, and the exact
Jaccard similarity of the shingle sets decides.

Exact copies are one class from the start; inside a bucket only the edges of a spanning forest
leave, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquia.llm.common import durable, pick, whole
from colloquia.llm.components import connected
from colloquia.llm.phrases import mix

DISTANCE, BLOCKS, WIDTH, SEED = 3, 5, 3, 42
CHUNK = 20000  # members of a bucket that are compared in one task; larger buckets meet chunk by chunk
SMALL = 64  # buckets up to this size are first tested for any link, all at once
BANDS, ROWS = 24, 6  # keys under which similar shingle sets meet, and minima in each
CELL = 1 << 20  # shingles of a candidate group that are compared in one task; larger groups meet cell by cell
_TURNS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(2 * BANDS * ROWS)], np.uint64).reshape(2, -1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def bits_for(similarity: float, bits: int, deviations: float = 1) -> int:
    """Differing bits expected of two equally large shingle sets of this Jaccard similarity, plus some standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 values of the word shingles of a whole text, in their order."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split on 0x20, 0x09-0x0D
    parts = map(b" ".join, zip(*[found[i:] for i in range(width)])) if len(found) >= width else [b" ".join(found)] if found else []
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64)


def fingerprint(text: str | None, width: int = WIDTH, words: int = 1) -> np.ndarray:
    """SimHash of the word shingles of a whole text, as 64-bit words; 0 without a word."""
    return simhash(shingles(text, width), words)


def simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """The first word takes the shingles' XXH64 values; further ones take values mixed from them."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 rows fit a byte
        part = hashes[at : at + 255]
        rows = part[:, None] if words == 1 else mix(part[:, None], np.arange(words, dtype=np.uint64)[None, :])
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def hashed(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64(whole(F.col("text"))).alias("text_hash"), "text")


def fingerprints(docs: DataFrame, width: int = WIDTH, words: int = 1) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every document as signed longs."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.concatenate([np.empty(0, np.uint64)] + [fingerprint(t.as_py(), width, words) for t in batch.column(2)]).view(np.int64)
            ends = pa.array(np.arange(0, len(marks) + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(marks))], ["doc_id", "text_hash", "fp"])

    return hashed(docs).mapInArrow(compute, "doc_id long, text_hash long, fp array<long>")


def pigeonhole_keys(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[Column]:
    """Parts of a 64-bit fingerprint of which pairs within ``distance`` share at least one."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.col("fp")[0].bitwiseAND(F.lit(signed(sum(m))).cast("long")) for m in combinations(block, blocks - distance)]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """MinHash keys of a set of shingle hashes: two sets share each with probability (Jaccard similarity) ** ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        least = np.minimum(least, ((hashes[at : at + 256, None] ^ _TURNS[0]) * (_TURNS[1] | np.uint64(1))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, ROWS)], np.uint64)


def shingle_marks(docs: DataFrame, width: int, words: int) -> DataFrame:
    """(doc_id, text_hash, id, n, fp, bands): per document its set of shingles, as a name, a size, a fingerprint and keys."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), width)) for t in batch.column(2)]
            longs = lambda rows, n: pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * len(sets) + 1, n, dtype=np.int32)), pa.array(np.concatenate([np.empty(0, np.uint64), *rows]).view(np.int64)))
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names), pa.array([len(s) for s in sets], pa.int64()),
                 longs([simhash(s, words) for s in sets], words), longs([band_keys(s) for s in sets], BANDS)],
                ["doc_id", "text_hash", "id", "n", "fp", "bands"])

    return hashed(docs).mapInArrow(compute, "doc_id long, text_hash long, id long, n long, fp array<long>, bands array<long>")


def away(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows, words)."""
    return np.bitwise_count(rows ^ one).sum(axis=1, dtype=np.int64)


def forest(marks: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (row numbers) that connect all fingerprints reachable by steps of at most ``distance`` bits.

    Breadth-first with removal: a row is compared only with rows not yet reached, so a dense
    cluster costs little more than its size.
    """
    edges, left = [], np.arange(len(marks))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = away(marks[left], marks[here]) <= distance
            if near.any():
                edges += [(here, r) for r in left[near]]
                queue += list(left[near])
                left = left[~near]
    return edges


def bucket_edges(marks: np.ndarray, start: np.ndarray, size: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Forests of many buckets, given where each starts and its size; most small ones have no link at all."""
    linked = np.zeros(len(start), bool)
    group = np.repeat(np.arange(len(start)), size)
    small = np.repeat(size <= SMALL, size)
    for step in range(1, min(SMALL, int(size.max(initial=1)))):
        a = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        if len(a):
            linked[group[a[away(marks[a], marks[a + step]) <= distance]]] = True
    edges = []
    for i in np.flatnonzero(linked | (size > SMALL)):
        edges += [(start[i] + x, start[i] + y) for x, y in forest(marks[start[i] : start[i] + size[i]], distance)]
    return edges


def links(classes: DataFrame, keys: list[Column], distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between the ids of fingerprints, enough to connect all that link.

    Takes one row (id, fp) per fingerprint. A bucket with more than ``chunk`` members is cut
    into chunks and every two chunks meet in a cell of their own, so no task holds more than
    two chunks of a bucket and no pair is lost.
    """
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("block"), k.alias("part")) for i, k in enumerate(keys)])
    named = classes.select("id", F.explode(parts).alias("key")).select("id", "key.block", "key.part")
    hot = named.groupBy("block", "part").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > chunk)
    busy = classes.select("id", "fp", F.explode(parts).alias("key")).select("id", "fp", "key.block", "key.part")
    cells = F.ceil(F.coalesce("members", F.lit(1)) / chunk)
    mine = F.pmod(F.xxhash64("id"), F.col("cells"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda j: F.least(j, F.col("mine")) * F.col("cells") + F.greatest(j, F.col("mine")))
    most = hot.count()  # usually none
    if most:
        busy = busy.join(hot, ["block", "part"], "left").withColumn("cells", cells).withColumn("mine", mine).select("id", "fp", "block", "part", F.explode(meet).alias("cell"))
    else:
        busy = busy.withColumn("cell", F.lit(0).cast("long"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(i).to_numpy() for i in range(4)] + [b.column(4).flatten().to_numpy().reshape(b.num_rows, -1)] for b in batches if b.num_rows]
        if not held:
            return
        ids, block, part, cell, marks = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((ids, cell, part, block))
        ids, block, part, cell, marks = ids[order], block[order], part[order], cell[order], marks[order].view(np.uint64)
        new = np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (cell[1:] != cell[:-1])]
        start = np.flatnonzero(new)
        edges = bucket_edges(marks, start, np.diff(np.r_[start, len(ids)]), distance)
        if edges:
            ends = ids[np.array(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return busy.repartition("block", "part", "cell").select("id", "block", "part", "cell", "fp").mapInArrow(connect, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Per document its fingerprint and the group of documents reachable by near fingerprints.

    Returns doc_id, text_hash, fp, id (of the fingerprint), root (least id of the group) and
    component_id (the group's smallest doc_id; null ids count only where there is no other).
    Texts without a word have fingerprint 0 and link like any other. An empty table gives no rows.
    """
    rows = durable(fingerprints(docs, width).withColumn("id", F.col("fp")[0]))
    classes = durable(rows.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp")))
    return grouped(rows, classes, connected(links(classes, pigeonhole_keys(distance), distance, chunk)))


def grouped(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    member = classes.join(roots, classes["id"] == roots["node"], "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(member.drop("first").join(named, "root"), "id")


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges (row numbers) that connect all sets reachable by steps of at least this Jaccard similarity.

    Breadth-first with removal, as in ``forest``; only linked sets are removed, so a rejected pair
    never hides another link.
    """
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start, of, has = np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(len(sets)), sizes), np.zeros(len(code) + 1, bool)
    edges, left, alive, mine = [], np.arange(len(sets)), np.ones(len(sets), bool), code
    while len(left) > 1:
        queue, alive[left[0]], left = [left[0]], False, left[1:]
        while queue and len(left):
            here = queue.pop()
            own = code[start[here] : start[here + 1]]
            has[own] = True
            shared = np.bincount(of[has[mine]], minlength=len(sets))[left]
            has[own] = False
            near = shared / np.maximum(1, sizes[here] + sizes[left] - shared) >= similarity
            if near.any():
                edges += [(here, r) for r in left[near]]
                queue += list(left[near])
                alive[left[near]] = False
                left = left[~near]
                mine, of = mine[alive[of]], of[alive[of]]
    return edges


def alike_links(docs: DataFrame, classes: DataFrame, near: DataFrame, width: int, similarity: float, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between shingle sets of one candidate group, enough to connect all of this Jaccard similarity.

    ``near`` has (node, root) of the candidate groups. The sets are made again from one document
    each. Groups of more than ``cell`` shingles are cut into parts, every two of which meet.
    """
    pairs = near.select(F.col("node").alias("id"), F.col("root").alias("group")).union(near.select("root", "root").distinct())
    wanted = durable(pairs.join(classes.select("id", "n", "copy"), "id"))
    large = wanted.groupBy("group").agg(F.ceil(F.sum("n") / cell).alias("cells")).filter("cells > 1")
    if large.count():
        wanted = wanted.join(large, "group", "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("long")))
    else:
        wanted = wanted.withColumn("cells", F.lit(1).cast("long"))
    wanted = wanted.select("id", "group", "cells", F.col("copy.id").alias("from_id"), F.col("copy.hash").alias("from_hash"))
    texts = hashed(docs)
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["from_id"]) & (texts["text_hash"] == wanted["from_hash"])).select("id", "group", "cells", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = pa.array(np.unique(batch.column(0).to_numpy(), return_index=True)[1])  # of repeated rows
            ids, group, cells, text = (c.take(once) for c in batch.columns)
            own = [np.unique(shingles(t.as_py(), width)) for t in text]
            ends = pa.array(np.cumsum([0] + [len(s) for s in own]).astype(np.int32))
            values = pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, group, cells, pa.ListArray.from_arrays(ends, values)], ["id", "group", "cells", "shingles"])

    mine = F.pmod(F.xxhash64("id"), F.col("cells"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda j: F.least(j, mine) * F.col("cells") + F.greatest(j, mine))
    dealt = found.mapInArrow(sets, "id long, group long, cells long, shingles array<long>").select("id", "group", F.explode(meet).alias("cell"), "shingles")

    def compare(held: list[tuple]) -> pa.RecordBatch:
        ids = np.array([h[0] for h in held])
        ends = ids[np.array(alike([h[1] for h in held], similarity), np.int64).reshape(-1, 2)]
        ends = ends[ends[:, 0] != ends[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            ids, group, at = (batch.column(i).to_pylist() for i in range(3))
            for i, key in enumerate(zip(group, at)):
                if key != now and held:
                    yield compare(held)
                    held = []
                now = key
                held.append((ids[i], batch.column(3)[i].values.to_numpy().copy()))
        if held:
            yield compare(held)

    ordered = dealt.repartition("group", "cell").sortWithinPartitions("group", "cell").select("id", "group", "cell", "shingles")
    return ordered.mapInArrow(connect, "a long, b long").distinct()


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 8, chunk: int = CHUNK, cell: int = CELL) -> DataFrame:
    """Groups of documents reachable by steps of at least this Jaccard similarity of their sets of word shingles.

    Columns as in ``near_duplicates``; ``id`` names the set, so equal sets are one class.
    Candidates share a MinHash key and differ in at most the bits expected at the border plus
    three standard deviations; inside a candidate group all pairs count by their exact similarity.
    """
    rows = durable(shingle_marks(docs, width, words))
    copy = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    classes = durable(rows.groupBy("id").agg(F.min("doc_id").alias("first"), copy.alias("copy"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    keys = [F.col("bands")[i] for i in range(BANDS)]
    near = connected(links(classes, keys, bits_for(similarity, 64 * words, 3), chunk))
    return grouped(rows.drop("n", "bands"), classes, connected(alike_links(docs, classes, near, width, similarity, cell)))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the smallest doc_id, then text hash."""
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    kept = groups.groupBy("root").agg(least.alias("k")).select(F.col("k.id").alias("id"), F.col("k.hash").alias("hash"))
    marks = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*marks)
    at = {n: F.col(marks[docs.columns.index(n)]) for n in ("doc_id", "text")}
    rows = flat.withColumns({"id": at["doc_id"].cast("long"), "hash": F.xxhash64(whole(at["text"]))})
    match = rows["id"].eqNullSafe(kept["id"]) & (rows["hash"] == kept["hash"])
    found = rows.join(kept, match, "left_semi")
    return found.dropDuplicates(["id", "hash"]).select(*marks).toDF(*docs.columns)  # equal rows: one stays
