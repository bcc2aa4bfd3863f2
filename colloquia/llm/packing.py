"""Best-fit packing of tokenised documents by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` numbers) is planned on the driver:
large lengths are rounded up inside groups of about equal cardinality, configurations of the
few rounded sizes are optimised by column generation, actual lengths take their places, and
what is left is best-fitted. The plan is a table of runs (length, first rank, count) that
places every piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia.llm.common import durable, pick, ranked

CAPACITY = 2048
GROUPS = 32
LARGE = 1 / 8
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_loaded: dict[tuple[str, str], object] = {}


def tokenizer_files() -> tuple[str, str, str]:
    """Rank file, its pattern, and the same vocabulary as a tokenizers file."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def encoder(files: tuple[str, str, str]):
    """text -> ids. The rank form gives the same ids faster; texts that spell the special token go to the other."""
    ranks, pattern, full = files
    if files not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        slow = Tokenizer.from_file(full)
        _loaded[files] = lambda text: (np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32) if SPECIAL in text
                                       else fast.encode_to_numpy(text, disallowed_special=()))
    return _loaded[files]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str, str] | None = None) -> DataFrame:
    """Tokenise whole documents and cut those longer than ``capacity``; the first piece takes the remainder."""
    files = files or tokenizer_files()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                ends = range(first, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    start = max(0, end - capacity) if piece else 0
                    out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Column generation for the few-size cutting problem: (items per size, whole times) pairs.

    Start from one-size configurations; while some configuration is worth more than one bin at
    the current prices (an unbounded knapsack), pivot it in; round the solution down.
    """
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = np.array(demand, float)
    size = np.array(sizes)
    for _ in range(20 * n):
        inverse = np.linalg.inv(basis)
        price = np.ones(n) @ inverse
        worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            fits = np.flatnonzero(size <= room)
            worth[room], choice[room] = worth[room - 1], -1
            if len(fits):
                gain = price[fits] + worth[room - size[fits]]
                best = int(np.argmax(gain))
                if gain[best] > worth[room] + 1e-12:
                    worth[room], choice[room] = gain[best], fits[best]
        if worth[capacity] <= 1 + 1e-6:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if choice[room] < 0:
                room -= 1
            else:
                column[choice[room]] += 1
                room -= sizes[choice[room]]
        step, level = inverse @ column, inverse @ amount
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    times = np.floor(np.linalg.inv(basis) @ amount + 1e-6)
    return [([int(x) for x in basis[:, j]], int(times[j])) for j in range(n) if times[j] >= 1]


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece.

    Piece number first rank + i of that length goes to sequence first sequence + i. Size and
    work depend on the number of distinct lengths, not on the number of pieces.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room left: [first sequence, count]
    opened = 0

    def put(length: int, first: int, count: int, room: int) -> None:
        runs.append((length, used[length], count, first, capacity - room))
        used[length] += count

    big = [x for x in sorted(counts, reverse=True) if x > capacity * large and counts[x]]
    total = sum(counts[x] for x in big)
    members: list[list[int]] = []
    seen = 0
    for length in big:  # a group starts at every total / groups pieces
        if not members or seen * groups // max(1, total) >= len(members):
            members.append([])
        members[-1].append(length)
        seen += counts[length]
    if members:
        sizes, demand = [g[0] for g in members], [sum(counts[x] for x in g) for g in members]
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [g for g, n in enumerate(pattern) for _ in range(n)]
            while times:
                wanted: dict[int, int] = {}
                chosen, room = [], capacity
                for k, g in enumerate(slots):  # the longest pieces left in the group; the last slot takes the longest that fits
                    choice = members[g] if k < len(slots) - 1 else [x for x in big if x <= room]
                    length = next((x for x in choice if counts[x] - used[x] > wanted.get(x, 0)), None)
                    if length is None:
                        break
                    wanted[length] = wanted.get(length, 0) + 1
                    chosen.append(length)
                    room -= length
                if len(chosen) < len(slots):
                    break
                run = min(times, *((counts[x] - used[x]) // n for x, n in wanted.items()))
                room = capacity
                for length in chosen:
                    put(length, opened, run, room)
                    room -= length
                free[room].append([opened, run])
                opened, times = opened + run, times - run
    for length in sorted(counts, reverse=True):  # best fit of what is left, long ones first
        while (left := counts[length] - used[length]) > 0:
            room = next((r for r in range(length, capacity + 1) if free[r]), None)
            if room is None:
                need = -(-left // (capacity // length))
                free[capacity].append([opened, need])
                opened += need
                continue
            bins = free[room][-1]
            run = min(left, bins[1])
            put(length, bins[0], run, room)
            free[room - length].append([bins[0], run])
            bins[0] += run
            bins[1] -= run
            if not bins[1]:
                free[room].pop()
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str, str] | None = None, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are the one closing token. Equal rows are packed each on their own. Rows of one
    length are ordered by doc_id, piece, checksum. An empty table gives no rows.
    """
    pieces = durable(token_pieces(docs, capacity, files))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    starts, total = {}, 0
    for length in sorted(counts):
        starts[length] = total
        total += counts[length]
    runs = [(x, starts[x] + first, starts[x] + first + n, sequence, offset) for x, first, n, sequence, offset in plan_runs(counts, capacity, groups, large)]
    plan = pieces.sparkSession.createDataFrame(runs or [(0, 0, 0, 0, 0)], "run_length int, since long, until long, sequence long, offset long")
    order = ranked(pieces, "length", "doc_id", "piece", "ids_crc32", "start", name="place")
    # the plan's size is bounded by the number of distinct lengths, so it may be broadcast
    fits = (F.col("length") == F.col("run_length")) & (F.col("place") >= F.col("since")) & (F.col("place") < F.col("until"))
    return order.join(F.broadcast(plan), fits).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.col("place") - F.col("since")).alias("sequence_id"), "offset")
