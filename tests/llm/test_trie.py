"""The conversation trie against plain dictionaries, at every bound, and centroid sums against a walk."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquia.llm import trie
from colloquia.llm.common import reachable
from colloquia.llm.queries import QUERIES
from tests.llm.conftest import SMALL, table

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(v, key=lambda t: (*t[:2], t[2].encode(), t[3]))] for c, v in talks.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(talks):
        h, rest = zlib.crc32(str(c).encode()) % 4, int(np.fmod(c, 20))
        path = tuple(talks.get(c - rest, [])[:h] + talks[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("bound", [trie.BOUND, 40, 4])
def test_equals_dictionaries(spark, bound):
    rows = [tuple(r) for r in table("conversations", SMALL)]
    rng = random.Random(5)
    for c in range(1000, 1060):  # shared beginnings, short bases, repeated turns and roles that differ
        for t in range(rng.randrange(7)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "a b"])))
    rows += [(1100, None, None, None), (1100, 1, "bot", None), (1100, 1, "user", "z"), (1100, 1, "user", "z"), (-7, 0, "u", "x"), (None, 1, "u", "lost"), (1103, 0, "u", "only"), (1119, 5, "u", "x")]
    rows += [(2000 + k, t, "u", f"w {min(t, 9)}") for k in range(30) for t in range(5)]  # many copies
    rows += [(3000, t, "u", f"deep {t}") for t in range(150)] + [(3000 + k, t, "u", f"deep {t}" if t < 3 * k else f"other {k}") for k in range(1, 12) for t in range(3 * k + 1)]  # a comb
    got = found(trie.prefix_trie(reachable(spark).createDataFrame(rows, TURNS).repartition(3), bound))
    assert got == plain(rows)


def test_query_and_odd_tables(spark):
    rows = [tuple(r) for r in table("conversations", SMALL)]
    assert found(QUERIES["op11_conversation_trie"](spark, SMALL)) == plain(rows)
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(rows[:9], TURNS).select("*", F.lit(1).alias("k1"), F.lit(2).alias("TEXT"), F.lit(3).alias("depth"))
    assert found(trie.prefix_trie(docs)) == plain(rows[:9])
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 10**6), min_size=1, max_size=80), st.booleans())
def test_centroid_sums(links, deep):
    parent = np.array([-1 if i == 0 or x < 0 else (i - 1 if deep and x % 3 else x % i) for i, x in enumerate(links)])
    depth, value = np.zeros(len(parent), int), np.array([[i % 7, 1] for i in range(len(parent))])
    for i, p in enumerate(parent):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    wanted = value.copy()
    for i in range(len(parent) - 1, 0, -1):
        if parent[i] >= 0:
            wanted[parent[i]] += wanted[i]
    assert (trie.centroid_sums(parent, depth, wanted[:, 1] * 3, value) == wanted).all()
