"""Every operator over nulls, empty and long texts, repeated rows, clashing columns, and no rows."""

import pytest
from pyspark.sql import functions as F

from colloquia.llm import language, mixing, packing, quality, sharding, simhash, suffixes, toxicity
from tests.llm.conftest import TRICKY

OPERATORS = {
    "language": lambda d, x: language.identify(d, *language.fit(d)),
    "sharding": lambda d, x: sharding.hilbert_shards(d, 4),
    "quality": quality.judge,
    "suffixes": lambda d, x: suffixes.digests(d),
    "mixing": lambda d, x: mixing.mix(d),
    "toxicity": lambda d, x: toxicity.score(d, *toxicity.fit(d, x)),
    "simhash": lambda d, x: simhash.near_duplicates(d),
    "similar": lambda d, x: simhash.similar(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(tricky, labels, name):
    ids = [r[0] for r in OPERATORS[name](tricky, labels).select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(str(t[0]) for t in TRICKY)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(nothing, labels, name):
    assert OPERATORS[name](nothing, labels.limit(0)).collect() == []


def test_no_rows_packed(nothing):
    assert packing.pack(nothing).collect() == []


def test_defined_results(tricky, labels):
    row = lambda df, i: df.filter(F.col("doc_id") == i).first()
    found = language.identify(tricky, *language.fit(tricky))
    for i in (4, 5, 6, 12):
        assert (row(found, i)["lang_pred"], row(found, i)["score"]) == ("und", 0.0)
    scored = toxicity.score(tricky, *toxicity.fit(tricky, labels))
    assert row(scored, 4)["score"] == row(scored, 5)["score"] == 0.0
    judged = quality.judge(tricky, labels)
    assert row(judged, 4)["n_words"] == 0 and row(judged, 4)["base_failed"] and not row(judged, 4)["kept"]
    assert row(judged, 8)["base_failed"] and row(judged, 8)["n_repeat_words"] == 4000
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(tricky).collect()}
    assert {(4, 4), (5, 4), (6, 4), (2, 1), (None, 9), (9, 9)} <= groups


@pytest.mark.parametrize("keep", [lambda d, x: quality.kept_documents(d, x), lambda d, x: suffixes.deduplicated(d), lambda d, x: mixing.mixed_documents(d),
                                  lambda d, x: simhash.keep_one(d, simhash.similar(d))])
def test_stages_keep_all_columns(tricky, nothing, labels, keep):
    out = keep(tricky, labels)
    assert out.columns == tricky.columns
    out.collect()
    assert keep(nothing, labels).collect() == []


def test_one_of_each_group_stays(tricky):
    kept = sorted(str(r[0]) for r in simhash.keep_one(tricky, simhash.near_duplicates(tricky)).select("doc_id").collect())
    assert kept == sorted(map(str, [1, 3, 4, 7, 8, 9, 10, 11, 12]))
