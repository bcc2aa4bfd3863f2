"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquia.llm import language, mixing, neighbours, packing, phrases, quality, queries, sharding, simhash, suffixes, toxicity, urls
from tests.llm.conftest import MIDDLE, SMALL, TRICKY, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# ---- sharding

def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    place = sharding.hilbert_index(cells, 3)
    assert sorted(place) == list(range(512))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_prune(spark):
    found = queries.QUERIES["op2_hilbert_shards"](spark, MIDDLE).toPandas()
    counts = found.groupby("shard").slot.agg(["count", "min", "max"])
    assert len(counts) == 24 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()
    docs = {d: t or "" for d, t, *_ in table("documents", MIDDLE)}
    for d, size, crc in zip(found.doc_id, found["size"], found.text_crc32):
        assert (size, crc) == (len(docs[d].encode()) + 8, zlib.crc32(docs[d].encode()))
    ranges = sharding.shard_ranges(sharding.hilbert_shards(spark.read.parquet(f"{MIDDLE}/documents.parquet"))).toPandas()
    for dim in ("lang_order", "source_order", "size"):  # a reader of one value skips about half of the shards by any dimension
        values = ranges[f"least_{dim}"].tolist() + ranges[f"most_{dim}"].tolist()
        read = [((ranges[f"least_{dim}"] <= v) & (ranges[f"most_{dim}"] >= v)).mean() for v in values]
        assert np.mean(read) < 0.65, (dim, np.mean(read))


def test_sources_with_one_beginning_stay_apart(spark):
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id * 7 % 50 as int))").alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 9 > 0, F.concat(F.lit("https://site-"), F.col("id") * 5 % 8)).alias("source"))
    found = sharding.hilbert_shards(docs, 24).toPandas()
    assert found.groupby("source", dropna=False).source_order.nunique().max() == 1 and found.source_order.nunique() == 9
    assert found.source_order_cell.nunique() == 9 and (found[found.source.isna()].source_order == 0).all()
    ranges = sharding.shard_ranges(sharding.hilbert_shards(docs, 24)).toPandas()
    read = [((ranges.least_source <= f"https://site-{i}") & (ranges.most_source >= f"https://site-{i}")).mean() for i in range(8)]
    assert np.mean(read) < 0.5 and ranges.null_source.sum() == found.source.isna().sum()


@pytest.mark.parametrize("small", [10000, 0])
def test_ranks_do_not_need_a_broadcast(spark, tricky, monkeypatch, small):
    monkeypatch.setattr(sharding, "SMALL_RANKS", small)
    found = sharding.hilbert_shards(tricky, 4).collect()
    order = sorted({t[3] for t in TRICKY}, key=lambda v: (v is not None, (v or "").encode()))
    assert Counter((r["source"], r["source_order"]) for r in found) == Counter((t[3], order.index(t[3])) for t in TRICKY)


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame(TRICKY, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.union(spark.createDataFrame([(None, "same", "en", None, 4)] * 5 + [(None, None, None, None, None), (3, prose(3, 130), "de", "z", 5)], docs.schema))
    sharded = sharding.hilbert_shards(docs, 4)
    sharding.write_shards(docs, sharded, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(rows(out, *docs.columns)) == Counter(rows(docs, *docs.columns))
    assert Counter(rows(out, "shard", "slot", "doc_id", "source")) == Counter(rows(sharded, "shard", "slot", "doc_id", "source"))
    for shard, n, last in rows(out.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("last")), "shard", "n", "last"):
        assert last == n - 1
    with pytest.raises(ValueError):
        sharding.write_shards(docs.filter("doc_id is not null"), sharded, str(tmp_path / "other"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # a large shard is several files, each a range of slots
        sharding.write_shards(docs, sharding.hilbert_shards(docs, 1), str(tmp_path / "one"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ends = [(r["a"], r["b"], r["n"]) for r in spark.read.parquet(str(tmp_path / "one")).groupBy(F.input_file_name()).agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()]
    assert len(ends) > 1 and all(b - a + 1 == n for a, b, n in ends)


# ---- mixing

def test_mix_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(queries.ORACLES["op6_water_filling_mix"])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, rows(queries.QUERIES["op6_water_filling_mix"](spark, SMALL), *columns))) == sorted(map(repr, want.fetchall()))


def test_targets_by_hand(spark):
    docs = spark.createDataFrame([(i, "w " * n, None, s, 0) for i, (s, n) in enumerate([("a", 100), ("b", 1000), ("b", 1000), (None, 400), ("c", 10)])],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    # budget 3765 at weights 3, 1, 2, 3; a, c and the null source stop at twice their size, b takes the rest
    assert target == {"a": 200.0, "b": 2745.0, "c": 20.0, None: 800.0}


def test_equal_documents_end_on_a_bucket_border(spark):
    """Sums that hit the fraction exactly, also with documents without a word around the border."""
    docs = [(i, "w " * 100, "even") for i in range(2)] + [(10 + i, "w " * 50, "many") for i in range(40)] + [(100 + i, "" if i % 3 else "w " * 20, "blank") for i in range(90)]
    con = duckdb.connect()
    for names in (["even"], ["many"], ["blank"], ["even", "many", "blank"]):
        mine = [d for d in docs if d[2] in names]
        con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", mine)
        want = con.execute(queries.ORACLES["op6_water_filling_mix"])
        columns = [c[0] for c in want.description]
        frame = spark.createDataFrame(mine, "doc_id long, text string, source string")
        found = mixing.mix(frame)
        assert sorted(map(repr, rows(found, *columns))) == sorted(map(repr, want.fetchall()))
        if len(names) == 1:
            assert found.agg(F.sum("taken")).first()[0] == 1.5 * sum(len(t.split()) for _, t, _ in mine)
        assert mixing.mixed_documents(frame).count() == found.agg(F.sum("copies")).first()[0]


def test_taken_words_meet_targets(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"),
                                   F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 30)).alias("source"))
    found = mixing.mix(hot).toPandas()
    by = found.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by.target - by.taken).abs().max() <= 25
    assert (found.taken <= 2 * found["size"]).all()
    assert mixing.mixed_documents(hot).count() == found.copies.sum()


# ---- packing

def test_pieces_round_trip(spark, tricky):
    from tokenizers import Tokenizer
    full = Tokenizer.from_file(packing.tokenizer_files()[2])
    found = packing.pack(tricky, capacity=64).toPandas()
    want = Counter()
    for doc_id, text, *_ in TRICKY:
        ids = full.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 64 + 1
        for piece, end in enumerate(range(first, len(ids) + 1, 64)):
            start = 0 if piece == 0 else end - 64
            want[(doc_id, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()))] += 1
    got = Counter((None if d != d else int(d), *map(int, r)) for d, *r in found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == want
    check_sequences(found, 64)


def check_sequences(found, capacity):
    found = found.sort_values(["sequence_id", "offset"])
    assert (found.groupby("sequence_id").length.cumsum() - found.length == found.offset).all()
    assert found.groupby("sequence_id").length.sum().max() <= capacity


def test_packing_is_tight(spark):
    found = queries.QUERIES["op9_linear_grouping_pack"](spark, MIDDLE).toPandas()
    check_sequences(found, 2048)
    assert found.sequence_id.nunique() <= 1.01 * -(-found.length.sum() // 2048) + 1


def best_fit_decreasing(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        at = min((i for i, r in enumerate(free) if r >= x), key=lambda i: free[i], default=None)
        if at is None:
            free.append(capacity)
            at = -1
        free[at] -= x
    return len(free)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(200, 1 + int(rng.expovariate(1 / 60))) for _ in range(600)]
    runs = packing.plan_runs(dict(Counter(lengths)), 200)
    placed = Counter({x: 0 for x in set(lengths)})
    for x, first, n, *_ in runs:
        assert first == placed[x]
        placed[x] += n
    assert placed == Counter(lengths)
    assert max(s + n for _, _, n, s, _ in runs) <= 1.03 * best_fit_decreasing(lengths, 200) + 1


# ---- SimHash

def brute_components(marks, distance):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(marks)):
        for j in np.flatnonzero(simhash.away(marks[i + 1 :], marks[i]) <= distance):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return [find(i) for i in range(len(marks))]


@pytest.mark.parametrize("chunk", [20000, 3])
def test_components_equal_all_pairs(spark, chunk):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("doc_id < 600")
    found = simhash.near_duplicates(docs, chunk=chunk).toPandas().sort_values("doc_id").reset_index(drop=True)
    marks = found["id"].to_numpy().view(np.uint64).reshape(-1, 1)
    roots = np.array(brute_components(marks, 3))
    assert (found.component_id.to_numpy() == found.doc_id.to_numpy()[roots]).all()


def test_dense_cluster_in_chunks(spark):
    rng = np.random.default_rng(1)
    marks = np.uint64(12345) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)], np.uint64)
    marks = np.unique(np.concatenate([marks, rng.integers(0, 1 << 63, 50).astype(np.uint64)])).view(np.int64)
    classes = spark.createDataFrame([(int(m), [int(m)]) for m in marks], "id long, fp array<long>")
    from colloquia.llm.components import connected
    roots = dict(rows(connected(simhash.links(classes, simhash.pigeonhole_keys(), chunk=40)), "node", "root"))
    want = brute_components(marks.view(np.uint64).reshape(-1, 1), 3)
    groups = Counter(want[i] for i in range(len(marks)))
    got = Counter(roots.get(int(m), int(m)) for m in marks)
    assert sorted(groups.values()) == sorted(got.values())


def test_fingerprint_by_definition():
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, *_ in TRICKY:
        words = WORD.findall((text or "").translate(lower))
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        assert int(simhash.fingerprint(text)[0]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text):
    words = WORD.findall((text or "").lower())
    return set(zip(*[words[k:] for k in range(5)]))


def test_similar_finds_near_copies_and_spares_others(spark):
    base = [(i, " ".join(f"w{random.Random(i * 1000 + k).randrange(5000)}" for k in range(200))) for i in range(60)]
    near = [(100 + i, t + " " + " ".join(f"z{i}{k}" for k in range(12))) for i, t in base[:30]]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in base + near], "doc_id long, text string, lang string, source string, n_chars long")
    found = dict(rows(simhash.similar(docs), "doc_id", "component_id"))
    assert all(len(shingles(t) & shingles(base[i - 100][1])) / len(shingles(t) | shingles(base[i - 100][1])) >= 0.9 for i, t in near)
    assert found == {i: i for i, _ in base} | {100 + i: i for i in range(30)}


def planted(similarities, pairs, size=360):
    """Texts of ``size`` shingles in pairs of just these Jaccard similarities, and chains whose ends are below 0.8."""
    fresh = iter(range(10**9))
    word = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    texts = []
    for similarity in similarities:
        shared = -(-2 * size * round(100 * similarity) // (100 + round(100 * similarity)))
        for _ in range(pairs):
            start = word(shared + 4)
            texts += [start + word(size - shared), start + word(size - shared)]
    for _ in range(pairs):
        line = word(size + 74)
        texts += [line[:364], line[35:399], line[70:434]]  # 0.82 from step to step, 0.67 from end to end
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("cell", [simhash.CELL, 700])
def test_similar_equals_exact_jaccard(spark, cell):
    texts = planted((0.70, 0.78, 0.80, 0.82), 40) + ["same words here and there " * 30, "same words here and there " * 50]
    sets, at = [shingles(t) for t in texts], {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, set()).add(i)
    want = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in sorted({j for x in s for j in at[x] if j > i}):
            if len(s & sets[j]) / len(s | sets[j]) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    assert len(set(want)) == 2 * 160 - 80 + 40 + 1
    found = dict(rows(simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cell=cell), "doc_id", "component_id"))
    assert [found[i] for i in range(len(texts))] == want


# ---- spans

def brute_spans(docs, span=50):
    least = {}
    for i, t in docs:
        for p in range(len(t) - span + 1):
            key = t[p : p + span]
            least[key] = min(least.get(key, suffixes.LAST), suffixes.LAST if i is None else i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if least[t[p : p + span]] < (suffixes.LAST if i is None else i):
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_spans_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randrange(40, 160))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(70)) for _ in range(rng.randrange(0, 6)))) for i in range(80)]
    docs += [(None, pool[0] + pool[1]), (7, pool[2]), (7, pool[2]), (200, None), (201, "ab" * 400), (202, "ab" * 300 + "c" * 60), (203, "x" * 49), (204, "x" * 50), (205, "x" * 51)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(repr, brute_spans([(i, (t or "").encode()) for i, t in docs])))
    names = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert sorted(map(repr, rows(suffixes.digests(frame, block_bytes=700), *names))) == want
    assert sorted(map(repr, rows(suffixes.digests(frame), *names))) == want


def test_phrases_cover_every_span_once_and_survive_cuts(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    ends = np.array([10, 10, 60, 1500, 1540, 5000])
    for piece in (1 << 20, 400):
        monkeypatch.setattr(phrases, "PIECE", piece)
        seen = Counter(int(s) + k for p in phrases.parse(data, ends) for s, n in zip(p.start, p.spans) for k in range(n))
        starts = [0, *ends[:-1]]
        assert seen == Counter(p for s, e in zip(starts, ends) for p in range(s, e - 49))


def test_removed_text_matches_digest(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = dict(rows(suffixes.deduplicated(docs), "doc_id", "text"))
    for i, n, removed in rows(suffixes.digests(docs), "doc_id", "n_bytes", "n_removed"):
        assert 0 <= n - removed - len((left[i] or "").encode()) <= 8  # characters cut in two


# ---- quality

def test_counts_and_ratio_by_definition(spark, tricky):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marked = spark.read.parquet(f"{SMALL}/labels.parquet")
    buckets = 1 << 10
    texts = {d: t or "" for d, t, *_ in table("documents", SMALL)}
    good = {d for d, q, _ in table("labels", SMALL) if q == 1}

    def grams(text):
        words = WORD.findall(text)
        one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        return [h % buckets for h in one] + [xxhash.xxh64_intdigest(b.encode(), h) % buckets for h, b in zip(one, words[1:])]
    raw, target = Counter(), Counter()
    for d, t in texts.items():
        raw.update(grams(t))
        if d in good:
            target.update(grams(t))
    sums = sum(target.values()) + 0.5 * buckets, sum(raw.values()) + 0.5 * buckets
    weight = [round(np.log((target[b] + 0.5) / sums[0]) - np.log((raw[b] + 0.5) / sums[1]), 4) for b in range(buckets)]
    for row in quality.judge(docs, marked, buckets=buckets).collect():
        text = texts[row["doc_id"]]
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = list(zip(words, words[1:], words[2:]))
        again = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in again for k in range(3)}
        assert tuple(row)[2:7] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        found = grams(text)
        assert row["score"] == pytest.approx(sum(weight[g] for g in found) / max(1, len(found)), abs=1e-9)


def test_labelled_junk_goes_and_prose_stays(spark):
    folder = "/root/testdata/sf0.1"
    found = dict(rows(queries.QUERIES["op3_ngram_ratio_rules"](spark, folder).filter("not base_failed"), "doc_id", "kept"))
    by = {0: [], 1: []}
    for d, q, _ in table("labels", folder):
        if d in found:
            by[q].append(found[d])
    assert np.mean(by[1]) > 0.995 and np.mean(by[0]) < 0.05


# ---- URLs

def python_split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.example.com/en/1", "http://example.com/EN/", "https://x.net/es/1://y", "http://net/fr/",
        "http://notnet/fr/", "https://É.COM?/en/", "http://a\nb.com/\nen/", "http://x.org/fr/" + "long" * 2000, "http://x.org/1", "http://x.org/1"]


def test_rules_by_definition(spark):
    pages = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, URL int")
    for row in urls.judge(pages).collect():
        host, path = python_split(URLS[row["page_id"]])
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (row["host"], row["path"], row["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert row["verdict"] in ("allow", "block") and (not fits or row["verdict"] == max(fits)[2])
    assert urls.judge(pages.limit(0)).collect() == []


def test_scores_by_definition(spark):
    order, names = 2, ["http://good.com/aab", "http://good.com/aac", "http://net/fr/zzz", "http://net/es/zza", "http://other.org/zzz"]
    pages = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    label = lambda u: "good" if ".com" in u else "bad" if "//net" in u else None
    counts = {c: Counter() for c in ("good", "bad")}
    for u in names:
        marked = "\2" * order + u + "\3"
        for c in filter(None, [label(u)]):
            counts[c].update(marked[i - k : i + 1] for i in range(order, len(marked)) for k in range(order + 1))

    def chance(c, gram):
        longer = chance(c, gram[1:]) if len(gram) > 1 else 1 / urls.ALPHABET
        after = {g: n for g, n in counts[c].items() if len(g) == len(gram) and g[:-1] == gram[:-1]}
        total = sum(after.values())
        return (after.get(gram, 0) + len(after) * longer) / (total + len(after)) if total else longer
    for row in urls.judge(pages, order=order).collect():
        marked = "\2" * order + names[row["page_id"]] + "\3"
        grams = [marked[i - order : i + 1] for i in range(order, len(marked))]
        assert row["score"] == pytest.approx(np.mean([np.log(chance("good", g)) - np.log(chance("bad", g)) for g in grams]), abs=1e-9)


# ---- neighbours

def exact(ids, data, q, k):
    score = (data * data[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
    return [(int(ids[q]), r + 1, int(ids[i]), score[i]) for r, i in enumerate(order)]


def test_recall_against_all_pairs(spark):
    ids, data = zip(*sorted((i, v) for i, v, _ in table("embeddings", "/root/testdata/sf0.1")))
    ids, data = np.array(ids), np.array(data, float)
    found = {(r[0], r[2]): r[3] for r in rows(queries.QUERIES["op7_collision_neighbours"](spark, "/root/testdata/sf0.1"), "query_id", "rank", "vec_id", "score")}
    want = [x for q in np.flatnonzero(ids % 20 == 0) for x in exact(ids, data, q, 20)]
    assert len(found) == len(want)
    hit = [found[(q, v)] == pytest.approx(s, abs=1e-9) for q, _, v, s in want if (q, v) in found]
    assert all(hit) and len(hit) / len(want) >= 0.9


def test_odd_vectors_ties_and_small_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 8)).astype(np.float32)
    data = [(i, [float(x) for x in base[i % 30]]) for i in range(60)]
    odd = [(100, None), (120, [0.0] * 8), (140, [float("nan")] + [1.0] * 7), (160, [None] + [1.0] * 7), (None, [1.0] * 8), (180, [float("inf")] * 8), (20, data[20][1]), (200, [9.0] * 3), (220, [9.0] * 16), (201, [9.0] * 16)]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    ids, matrix = np.arange(60), np.array([v for _, v in data])
    want = [x for q in (0, 20, 40) for x in exact(ids, matrix, q, 5)]
    for block_rows in (20000, 7):
        got = sorted(rows(neighbours.nearest(frame, k=5, block_rows=block_rows, query_rows=2), "query_id", "rank", "vec_id", "score"))
        assert [g[:3] for g in got] == [w[:3] for w in want]
    assert neighbours.nearest(frame.limit(0)).collect() == []


# ---- language and toxicity

def test_held_out_languages(spark):
    found = queries.QUERIES["op1_language_mixture"](spark, MIDDLE).filter("held_out").collect()
    lang = {d: x for d, _, x, *_ in table("documents", MIDDLE)}
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in found)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found]) > 0.98


def test_mixture_proportions():
    rng = np.random.default_rng(4)
    profiles = rng.dirichlet(np.full(400, 0.2), 5) + 1e-9
    profiles /= profiles.sum(axis=1, keepdims=True)
    mixed = rng.multinomial(4000, 0.7 * profiles[1] + 0.3 * profiles[3])
    share = language.infer(profiles, mixed)
    assert set(share) == {1, 3} and share[1] == pytest.approx(0.7, abs=0.05)
    assert set(language.infer(profiles, rng.multinomial(4000, profiles[2]))) == {2}


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = prose(3, 700) + " Ünïcode " + prose(4, 500)
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "PIECE", 97)
    assert (language.gram_counts(text) == whole).all()


def test_held_out_toxicity_and_places(spark):
    docs, marked = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marked)
    found = {r["doc_id"]: r for r in toxicity.score(docs, *model).collect()}
    held = [(found[d], t) for d, _, t in table("labels", "/root/testdata/sf0.1") if zlib.crc32(str(d).encode()) % 4 == 2]
    hits = sum(r["score"] >= 0.3 and t == 1 for r, t in held)
    assert hits / sum(t == 1 for _, t in held) > 0.8 and hits / sum(r["score"] >= 0.3 for r, _ in held) > 0.85
    texts = {d: t for d, t, *_ in table("documents", "/root/testdata/sf0.1")}
    english = [(d, s) for d, r in found.items() for s in r["offending"] or [] if s["score"] > 0.9]
    named = [bool(re.search(rb"trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron|ach|r\xc3\xa9|bo", texts[d].encode()[s["start"] : s["end"]].lower())) for d, s in english]
    assert np.mean(named) > 0.95


def test_noisy_or_learns_the_word_from_document_labels():
    rng = np.random.default_rng(0)
    word, sentence, of, label, n = [], [], [], [], 0
    for d in range(400):
        label.append(d % 2)
        bad = rng.integers(0, 5)
        for s in range(5):
            word += list(rng.integers(1, 30, 6)) + ([0] if label[-1] and s == bad else [])
            sentence += [n] * (6 + (1 if label[-1] and s == bad else 0))
            of.append(d)
            n += 1
    weight = toxicity.train(np.array(word), np.array(sentence), np.array(of), np.array(label), 30)
    assert weight[0] > 5 and np.abs(weight[1:]).max() < weight[0] / 2


def test_length_is_no_toxicity(spark):
    """100,000 harmless sentences stay harmless, whatever their words; one offending sentence among them is found."""
    docs, marked = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    label = {d: t for d, _, t in table("labels", "/root/testdata/sf0.1")}
    texts = {d: t for d, t, *_ in table("documents", "/root/testdata/sf0.1")}
    known, weight = toxicity.fit(docs, marked)
    alone = {r["doc_id"] for r in toxicity.score(docs, known, weight).filter("score < 0.1").collect()}
    clean = " ".join(texts[d].replace("\n", " ") for d in sorted(texts) if label.get(d) == 0 and d in alone)
    sentences = [s for s in clean.split(". ") if s]
    long = ". ".join((sentences * (100_000 // len(sentences) + 1))[:100_000])
    rude = "You are a pathetic idiot and worthless trash"
    rows = [(1, "The cat sat on the mat. " * 100_000), (2, long), (3, long + ". " + rude + ". " + "The cat sat. " * 5), (4, rude), (5, (rude + ". ") * 3), (6, "")]
    found = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), known, weight).collect()}
    assert found[1]["score"] == found[6]["score"] == 0.0 and not found[1]["offending"]
    assert found[2]["score"] < 0.3 < found[3]["score"] and found[4]["score"] > 0.3
    assert found[5]["score"] == pytest.approx(found[4]["score"]) and len(found[5]["offending"]) == 3
    assert [s["start"] >= len(long.encode()) for s in found[3]["offending"]].count(True) == 1


def test_scores_equal_plain_noisy_or(spark):
    """Scores and offending sentences of whole texts from the weights, by plain loops over sentences and words."""
    hashed = lambda part: toxicity.sentence_words(np.frombuffer(part.encode(), np.uint8))[0]
    texts = [t for _, t, *_ in table("documents", SMALL)][:40] + ["alpha beta! alpha beta! gamma. ", "alpha", "x"]
    known = np.unique(np.concatenate([hashed(w)[:, 0] for w in sorted({w for t in texts for w in re.findall(r"[a-z]{4,}", t.lower())})]))
    weight = np.random.default_rng(2).uniform(-3, 6, len(known))
    of_word = dict(zip(known.tolist(), weight.tolist()))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r for r in toxicity.score(frame, known, weight).collect()}
    for i, text in enumerate(texts):
        clean, seen, offending = 1.0, set(), 0
        for part in re.split(r"(?<=[\n!.?])", text):
            features = frozenset(h for h in hashed(part).ravel().tolist() if h in of_word)
            odds = toxicity.BIAS + sum(of_word[h] for h in features)
            if odds > toxicity.LEAST:
                p = 1 - (1 - 1 / (1 + np.exp(-odds))) / (1 - 1 / (1 + np.exp(-toxicity.LEAST)))
                clean *= 1 if features in seen else 1 - p
                offending += p >= 0.3
                seen.add(features)
        assert found[i]["score"] == pytest.approx(1 - clean, abs=1e-9) and len(found[i]["offending"]) == offending
    assert sum(r["score"] > 0.3 for r in found.values()) > 5
