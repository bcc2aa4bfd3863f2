"""Token alignment against loops over all byte positions, and the defined odd cases."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquia.llm import alignment
from colloquia.llm.common import reachable
from colloquia.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENTS, SMALL, TRICKY, table

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute_force(texts: list[str | None]) -> list[tuple]:
    """The same columns without doc_id by plain loops over byte positions, for tests."""
    a_encode, a_bytes, b_encode, b_bytes = alignment._tokenizers(alignment.tokenizer_files())
    found, count = [], Counter()
    for text in texts:
        spans, wanted = [], (" " + (text or "")).encode()
        for ids, size in ((a_encode(" " + text), a_bytes), (b_encode(text), b_bytes)) if text else ():
            if b"".join(size[i] for i in ids) == wanted:
                spans.append([(sum(len(size[j]) for j in ids[: k + 1]), i) for k, i in enumerate(ids)])
        if len(spans) < 2:
            found.append(None)
            continue
        links = [(x, y) for end, x in spans[0] for other, y in spans[1] if end == other]
        ends = sorted({e for e, _ in spans[0]} & {e for e, _ in spans[1]})
        groups = [tuple([i for e, i in side if low < e <= high] for side in spans) for low, high in zip([0, *ends], ends)]
        count.update(links)
        found.append((len(spans[0]), len(spans[1]), groups, links))
    top = {b: max(n for (_, y), n in count.items() if y == b) for _, b in count}
    out = []
    for row in found:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in row[2])
        out.append((row[0], row[1], len(row[2]), len(row[3]), sum(count[x] == top[x[1]] for x in row[3]), sum(count[x] for x in row[3]),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot_share", [alignment.HOT_SHARE, 1])
def test_equals_loops_over_positions(spark, hot_share):
    rows = [(r[0], r[1]) for r in table("documents", SMALL) if len(r[1]) < 2000][:60]
    odd = ["a  b", " lead", "naïve café 日本語 😀", "<|endoftext|> x <s>", "tab\tnew\nline  ", "\u2581 mark", "ﬁ ligature", "x\x00y", None, "", "a  b"]
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    docs = reachable(spark).createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.usual_links(docs, hot_share=hot_share).collect()}
    wanted = brute_force([t for _, t in rows])
    assert {i: found[i] for i, _ in rows} == {i: w for (i, _), w in zip(rows, wanted)}
    assert found[1008] == found[1009] == (0, 0, 0, 0, 0, 0, "")
    assert found[1000] == found[1010] and found[1000][0] > 0


def test_special_strings_are_plain_text(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    encode = alignment._tokenizers(alignment.tokenizer_files())[0]
    for text in ["a <|endoftext|> b", "<|endoftext|>", "plain"] + [t for _, t, *_ in TRICKY if t]:
        assert encode(" " + text) == full.encode(" " + text, add_special_tokens=False).ids


def test_odd_tables(spark, tricky, nothing):
    found = alignment.usual_links(tricky)
    assert found.count() == len(TRICKY)
    zero = {r["doc_id"] for r in found.filter("n_a = 0 and groups_sha256 = ''").collect()}
    assert {4, 5} <= zero
    assert alignment.usual_links(nothing).collect() == []
    assert QUERIES["op13_token_alignment"](spark, SMALL).columns == ["doc_id", *COLUMNS]


def test_groups_cover_all_tokens(spark):
    docs = reachable(spark).createDataFrame([(1, "Naïve tokenizers disagree, often.", None, None, 1)], DOCUMENTS)
    row = alignment.align(docs).first()
    groups = [[side.split(",") for side in g.split("|")] for g in row["groups"].split(";")]
    assert len(groups) == row["n_groups"] and sum(len(g[0]) for g in groups) == row["n_a"] and sum(len(g[1]) for g in groups) == row["n_b"]
    counts = alignment.pair_counts(alignment.align(docs))
    assert counts.agg(F.sum("count")).first()[0] == row["n_groups"]
