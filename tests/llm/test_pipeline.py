import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from colloquia.llm import queries, simhash, suffixes
from colloquia.llm.common import read
from tests.llm.conftest import SMALL
from tests.llm.test_operators import brute_components, brute_spans, check_sequences


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = read(spark, SMALL, "documents")
    columns, found = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), schema=stage(spark, docs, SMALL).schema)
        found[name] = docs
        if name != "packing":
            assert docs.columns == columns

    judged = queries.QUERIES["op3_ngram_ratio_rules"](spark, SMALL).filter("kept").select("doc_id").collect()
    passed = found["quality rules"].orderBy("doc_id").collect()
    assert sorted(r["doc_id"] for r in judged) == [r["doc_id"] for r in passed]

    import numpy as np
    marks = np.stack([simhash.fingerprint(r["text"], 5, 8) for r in passed])
    roots = brute_components(marks, simhash.bits_for(0.8, 512))
    kept = found["near duplicates"].orderBy("doc_id").collect()
    want = [r["doc_id"] for i, r in enumerate(passed) if roots[i] == i]
    lost = set(want) ^ {r["doc_id"] for r in kept}
    assert len(lost) <= 0.02 * len(want)  # a border pair may share no block

    left = {i: (n - gone) for i, n, gone, *_ in brute_spans([(r["doc_id"], r["text"].encode()) for r in kept])}
    cleaned = found["shared spans"].collect()
    assert {r["doc_id"] for r in cleaned} == set(left)
    assert all(0 <= left[r["doc_id"]] - len(r["text"].encode()) <= 8 for r in cleaned)

    con = duckdb.connect()
    con.register("documents", found["shared spans"].toPandas())
    copies = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({queries.ORACLES['op6_water_filling_mix']}) WHERE copies > 0").fetchall()}
    mixed = found["mixing"].toPandas()
    assert mixed.groupby("doc_id").size().to_dict() == copies

    packed = found["packing"].toPandas()
    check_sequences(packed, 2048)
    assert packed[packed.piece == 0].groupby("doc_id").size().to_dict() == copies


def test_removed_spans_use_ids_of_their_own_input(spark):
    docs = spark.createDataFrame([(5, "p" * 60), (9, "q" * 10 + "p" * 60)], "doc_id long, text string")
    assert dict(suffixes.deduplicated(docs).collect()) == {5: "p" * 60, 9: "q" * 10}
