"""Prefix trie of conversations with subtree roll-ups by centroid decomposition.

A node is a distinct sequence of first turns. Its key is a 128-bit sum of position-keyed turn
hashes, so keys are running sums and no conversation has to sit in one task. The measure of a
node (conversation rows in its subtree) comes out of the same aggregation and cuts the
parent-edge forest: below ``bound`` rows a subtree is one component that fits in a task, where
it is split at its centroid again and again; each part's total is added along the path from
the centroid to the component's top. What lies above is a small tree of totals that goes
through the same step with the bound raised by the same factor, until one component is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquia.llm.common import durable, pick, ranked, whole, word_count
from colloquia.operators.ordered import split_window

#: Rows of a component that one task splits; also the rows of a conversation that one task sums.
BOUND = 512
#: Keys that hold more than one in so many rows are joined by broadcast: there are fewer than so many.
HOT_SHARE = 4096
KEY = ["k1", "k2"]
ABOVE = ["q1", "q2"]
SOLVED = "k1 long, k2 long, q1 long, q2 long, parent_conv_id long, is_top boolean, n_children long, leaves long, saved long"


def share_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: Column, total: int, how: str = "inner", share: int = HOT_SHARE) -> DataFrame:
    """Join ``rows`` with a cut table of unique ``keys``; ``weight`` bounds the rows of a key, ``total`` all rows.

    Keys with more than one in ``share`` rows, fewer than ``share`` of them, are broadcast; no key of the shuffled rest is hot.
    """
    hot, rest = table.filter(weight > total / share), table.filter(weight <= total / share)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest, keys, how))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, n_words, a, b): turns by turn number (nulls first), then role, then a hash of the text; i from 1."""
    slim = pick(conversations, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    role, text = whole(F.col("role")), whole(F.col("text"))
    slim = slim.select(F.col("conv_id").cast("long"), "turn", role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), word_count(text).alias("n_words"))
    return ranked(durable(slim), "conv_id", "turn", "role", "a", "b").drop("turn", "role")


def rebuilt(conversations: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per turn of each rebuilt conversation, and one for its root at depth 0.

    Conversation c takes the first h = crc32(c) % 4 turns of conversation c - c % 20 and its own
    turns after its first h. Columns: conv_id, depth, last (its turns), n_words, key of the node
    (k1, k2) and of the one above (q1, q2). The remainder has the sign of c, as in SQL. Rows
    without a conv_id take no part.
    """
    turns = numbered_turns(conversations)
    counts = durable(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("_first")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    placed = share_join(turns, counts, ["conv_id"], F.col("n"), total).withColumn("i", F.col("rank") - F.col("_first") + 1).select("conv_id", "i", "n_words", "a", "b")
    placed = durable(placed)
    starts = placed.filter("conv_id % 20 = 0 and i <= 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "n_words", "a", "b"))).alias("starts"))
    joined = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int").alias("h"))
    joined = joined.join(starts.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.when(F.col("starts").isNull() | (F.col("h") == 0), F.array().cast("array<struct<i:long,n_words:long,a:long,b:long>>")).otherwise(F.slice("starts", 1, F.col("h")))
    plan = durable(joined.select("conv_id", "n", "h", head.alias("head")).withColumn("shift", F.size("head") - F.col("h")).withColumn(
        "last", F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))))
    first = plan.select("conv_id", "last", F.inline("head")).withColumnRenamed("i", "depth")
    own = share_join(placed, plan.drop("head"), ["conv_id"], F.col("n"), total).filter("i > h").withColumn("depth", F.col("i") + F.col("shift"))
    columns = ["conv_id", "depth", "last", "n_words", "a", "b"]
    rows = first.select(columns).unionByName(own.select(columns))
    x, y = F.xxhash64("depth", "a", "b"), F.xxhash64(F.lit(2), "b", "a", "depth")
    low = F.lit(0xFFFFFFFF)
    parts = {"s1": x.bitwiseAND(low), "s2": F.shiftrightunsigned(x, 32), "s3": y.bitwiseAND(low), "s4": F.shiftrightunsigned(y, 32)}
    rows = rows.select("conv_id", "depth", "last", "n_words", *[v.alias(f"x_{k}") for k, v in parts.items()])
    if (counts.agg(F.max("n")).first()[0] or 0) + 3 <= bound:
        running = Window.partitionBy("conv_id").orderBy("depth")
        summed = rows.select("*", *[F.sum(f"x_{k}").over(running).alias(k) for k in parts])
    else:  # a long conversation is summed in buckets
        cut = durable(rows.withColumn("_bucket", F.expr(f"depth div {bound}")))
        summed = split_window(cut, ["conv_id"], "_bucket", ["depth"], **{k: ("sum_through", F.col(f"x_{k}")) for k in parts})

    def key(depth, sums):
        return F.xxhash64(depth, *sums), F.xxhash64(F.lit(3), *sums[::-1], depth)

    here, above = [F.col(k) for k in parts], [F.col(k) - F.col(f"x_{k}") for k in parts]
    (k1, k2), (q1, q2) = key(F.col("depth"), here), key(F.col("depth") - 1, above)
    r1, r2 = key(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    null = F.lit(None).cast("long")
    roots = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), "last", F.lit(0).cast("long").alias("n_words"), r1.alias("k1"), r2.alias("k2"), null.alias("q1"), null.alias("q2"))
    return durable(summed.select("conv_id", "depth", "last", "n_words", k1.alias("k1"), k2.alias("k2"), q1.alias("q1"), q2.alias("q2")).unionByName(roots))


def _ends(to: np.ndarray) -> np.ndarray:
    """Where each node ends that follows ``to`` until it stays, by pointer doubling."""
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def centroid_sums(parent: np.ndarray, depth: np.ndarray, measure: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (one column each) over a forest, by centroid decomposition of all its trees at once.

    ``parent`` is -1 at a top; ``measure`` is positive, and at least the sum of its children's
    at every node. In each round every component is split at its deepest node that holds more
    than half of the measure: the total of the part below is added to each node from there to
    the component's top. Parts hold at most half each, so rounds grow with a logarithm.
    """
    n = len(parent)
    itself = np.arange(n)
    up = np.where(parent < 0, itself, parent)
    sums, left, open_ = np.zeros_like(values), measure.copy(), np.ones(n, bool)
    by_depth = np.argsort(depth, kind="stable")
    while open_.any():
        top = _ends(up)
        half = by_depth[(open_ & (2 * left > left[top]))[by_depth]]
        centroid_of = np.full(n, -1)
        centroid_of[top[half]] = half  # deeper ones come later and stay
        centroid = centroid_of[centroid_of >= 0]
        is_centroid = np.zeros(n, bool)
        is_centroid[centroid] = True
        below = _ends(np.where(is_centroid, itself, up))
        part = open_ & is_centroid[below]
        total = np.zeros_like(values)
        np.add.at(total, below[part], values[part])
        total, held = total[centroid], left[centroid]
        at, of = centroid, np.arange(len(centroid))
        sums[at] += total
        while True:  # the paths of different components share no node
            climbs = up[at] != at
            if not climbs.any():
                break
            at, of = up[at[climbs]], of[climbs]
            sums[at] += total[of]
            left[at] -= held[of]
        open_[centroid] = False
        freed = is_centroid[up]
        up[freed] = itself[freed]
    return sums


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components, sorted by (c1, c2): subtree sums, parents and child counts of their nodes."""
    names = ["k1", "k2", "q1", "q2", "conv_id", "depth", "measure", "leaves", "saved", "c1", "c2"]

    def solved(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(columns["k1"])
        pairs = np.stack([np.concatenate([columns["k1"], columns["q1"]]), np.concatenate([columns["k2"], columns["q2"]])])
        order = np.lexsort(pairs)
        fresh = np.concatenate([[True], (np.diff(pairs[:, order], axis=1) != 0).any(axis=0)])
        number = np.empty(2 * n, np.int64)
        number[order] = np.cumsum(fresh) - 1
        place = np.full(number.max() + 1, -1)
        place[number[:n]] = np.arange(n)
        parent = place[number[n:]]
        children = np.bincount(parent[parent >= 0], minlength=n)
        leaves = np.where(columns["leaves"] < 0, children == 0, columns["leaves"])
        sums = centroid_sums(parent, columns["depth"], columns["measure"], np.stack([leaves, columns["saved"]], axis=1))
        is_top = parent < 0
        parents = pa.array(columns["conv_id"][parent], mask=is_top)
        data = [columns[c] for c in ("k1", "k2", "q1", "q2")] + [parents, is_top, children, sums[:, 0], sums[:, 1]]
        return pa.RecordBatch.from_arrays([d if isinstance(d, pa.Array) else pa.array(d) for d in data], SOLVED.replace(" long", "").replace(" boolean", "").split(", "))

    kept = None
    for batch in batches:
        now = {c: batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
        if kept is not None:
            now = {c: np.concatenate([kept[c], now[c]]) for c in names}
        same = (now["c1"] == now["c1"][-1:]) & (now["c2"] == now["c2"][-1:])
        cut = len(same) - int(same.sum())
        if cut:
            yield solved({c: v[:cut] for c, v in now.items()})
        kept = {c: v[cut:] for c, v in now.items()}
    if kept is not None and len(kept["k1"]):
        yield solved(kept)


def solve(tree: DataFrame) -> DataFrame:
    columns = ["k1", "k2", "q1", "q2", "conv_id", "depth", "measure", "leaves", "saved", "c1", "c2"]
    return durable(tree.select(*[F.col(c).cast("long") for c in columns]).repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(_solve, SOLVED))


def _attached(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """Add the sums of subtrees that end under a node of ``tree`` to that node."""
    more = tops.groupBy(*ABOVE).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")).toDF(*KEY, "_leaves", "_saved")
    return tree.join(more, KEY, "left").withColumn("leaves", F.col("leaves") + F.coalesce("_leaves", F.lit(0))).withColumn(
        "saved", F.col("saved") + F.coalesce("_saved", F.lit(0))).drop("_leaves", "_saved")


def _solve_runs(light: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one upper level, as vertical runs of at most ``width`` nodes: (sums by node, the components' tops)."""
    run = ["conv_id", "band"]
    nodes = light.withColumn("band", F.expr(f"depth div {width}"))
    first = F.min_by(F.struct(*KEY, *ABOVE, "depth", "c1", "c2"), "depth").alias("top")
    runs = durable(nodes.groupBy(*run).agg(first, F.max("measure").alias("measure"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    of = nodes.select(*[F.col(c).alias(q) for c, q in zip(KEY, ABOVE)], *run).join(runs.select(*run, F.col("top.k1").alias("_k1"), F.col("top.k2").alias("_k2")), run).drop(*run)
    edges = runs.select("top.*", "conv_id", "measure", "leaves", "saved").join(of, ABOVE, "left").withColumnsRenamed({"q1": "n1", "q2": "n2", "_k1": "q1", "_k2": "q2"})
    done = solve(edges).drop("q1", "q2").join(edges.select(*KEY, F.col("n1").alias("q1"), F.col("n2").alias("q2")), KEY)
    inside = _attached(nodes, done.filter("not is_top"))
    below = Window.partitionBy(*run).orderBy(F.desc("depth"))
    sums = inside.select(*KEY, F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved"))
    return sums, done.filter("is_top")


def chained_hashes(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): hash of the comma-joined ids of each node, ascending.

    Ids are sorted and joined in many tasks; only the finished pieces of a node meet, in order and one at a time.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(k1) != 0) | (np.diff(k2) != 0)])) if len(ids) else np.zeros(0, int)
            texts, ends = ids.astype(str), [*starts[1:].tolist(), len(ids)]
            joined = [",".join(texts[a:b]) for a, b in zip(starts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(ids[starts]), pa.array(joined, pa.string())], ["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind = None, None, [("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if key == (k1, k2):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), o)) for o in out], pa.schema(kind))
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends_sha256": state.hexdigest()}], pa.schema(kind))

    pieces = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join, "k1 long, k2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Without conversations there is no node, not even a root. Turns
    equal in number, role and text stay separate turns; other columns are ignored.
    """
    rows = rebuilt(conversations, bound)
    total = rows.count()
    levels, reach = 1, bound
    while reach < total:
        levels, reach = levels + 1, reach * bound
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.count(F.lit(1)).alias("n_convs"),
                                   F.max("n_words").alias("n_words"), F.sum(F.col("last") - F.col("depth") + 1).alias("measure"))
    level = sum(((F.col("measure") > bound**j).cast("int") for j in range(1, levels)), F.lit(0))
    nodes = durable(nodes.withColumn("level", level).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_words")))
    r1, r2 = nodes.filter("depth = 0").select(*KEY).first() or (0, 0)
    root = F.struct(F.lit(r1).alias("k1"), F.lit(r2).alias("k2"))
    if levels > 1:
        upper = nodes.filter("level > 0").select(*KEY, "level", "n_convs")
        known = share_join(rows, upper, KEY, F.col("n_convs"), total, "left").withColumn("level", F.coalesce("level", F.lit(0)))
        tops = durable(known.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), *[F.min(F.when(F.col("level") < j, F.struct("depth", *KEY))).alias(f"t{j}") for j in range(1, levels)]))
        nodes = share_join(nodes, tops, ["conv_id"], F.col("_n"), total).withColumn(
            "top", F.coalesce(*[F.when(F.col("level") == j - 1, F.struct(f"t{j}.k1", f"t{j}.k2")) for j in range(1, levels)], root))
    else:
        nodes = nodes.withColumn("top", root)
    nodes = durable(nodes.select(*KEY, *ABOVE, "conv_id", "depth", "n_convs", "measure", "level", "saved", F.lit(-1).cast("long").alias("leaves"), F.col("top.k1").alias("c1"), F.col("top.k2").alias("c2")))
    low = solve(nodes.filter("level = 0"))
    found = low.select(*KEY, "parent_conv_id", "n_children", "leaves", "saved")
    if levels > 1:
        found = found.filter("parent_conv_id is not null").unionByName(_upper(nodes, low, levels, bound, total))
    hashes = chained_hashes(rows.filter("depth = last").select(*KEY, "conv_id"))
    kept = nodes.select(*KEY, "conv_id", "depth", "n_convs").join(found, KEY).join(hashes, KEY, "left")
    return kept.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _upper(nodes: DataFrame, low: DataFrame, levels: int, bound: int, total: int) -> DataFrame:
    """Results of all nodes above the lowest components, and of those components' tops."""
    tops, high = low.filter("is_top"), nodes.filter("level > 0")
    children = tops.select(*ABOVE).unionByName(high.select(*ABOVE)).groupBy(*ABOVE).agg(F.count(F.lit(1)).alias("n_children")).toDF(*KEY, "n_children")
    high = high.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = durable(_attached(high.withColumn("leaves", (F.col("n_children") == 0).cast("long")), tops))
    counted, sums = tree.select(*KEY, *ABOVE, "n_children", "conv_id"), None
    for j in range(2, levels + 1):
        part, part_tops = _solve_runs(tree.filter(F.col("level") == j - 1), bound ** (j - 1))
        sums = part if sums is None else sums.unionByName(part)
        if j < levels:
            tree = durable(_attached(tree.filter(F.col("level") >= j), part_tops))
    above = counted.select(*[F.col(c).alias(q) for c, q in zip(KEY, ABOVE)], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    rest = counted.drop("conv_id").join(sums, KEY).unionByName(tops.select(*KEY, *ABOVE, "n_children", "leaves", "saved"))
    return share_join(rest, above, ABOVE, F.col("_n"), total, "left").select(*KEY, "parent_conv_id", "n_children", "leaves", "saved")
