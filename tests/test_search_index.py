"""The stored search index: same answers as a scan, pruned reads, small rewrites."""

from colloquia.operators import catalog as cat
from colloquia.sources.search import SearchIndex

IMAGE = "hash string, prompt string, negative_prompt string, checkpoint string"


def hits(df):
    return sorted(r.hash for r in df.collect())


def test_index_equals_scan_and_follows_changes(spark, tmp_path):
    words = "red green blue Café sky sea stone light lamp river".split()
    rows = [(f"h{i}", f"{words[i % 10]} {words[i * 7 % 10]}", words[i % 3], f"model_{i % 4}") for i in range(60)]
    images, loras = spark.createDataFrame(rows, IMAGE), spark.createDataFrame([(f"h{i}", f"style-{i % 5}") for i in range(0, 60, 2)], "hash string, lora_name string")
    index = SearchIndex(str(tmp_path / "i"), 32)
    index.update(images, loras)
    queries = ["re", "caf sky", "STYLE 3", "model_2 bl", "nothing", "s", "", "st li"]
    for text in queries:
        assert hits(index.search(images, text)) == hits(cat.f_text(images, cat.search_tokens(images, loras), text)), text
    assert index.update(images, loras) == []  # nothing changed, nothing is written
    later = [("h7", "violet sky", "", "model_9"), ("h8", "", "", ""), ("new", "violet", "", "")]
    written = index.update(spark.createDataFrame(later, IMAGE), loras)
    assert 0 < len(written) < 32
    now = spark.createDataFrame([r for r in rows if r[0] not in ("h7", "h8")] + later, IMAGE)
    for text in [*queries, "violet", "model 9", "lamp"]:
        assert hits(index.search(now, text)) == hits(cat.f_text(now, cat.search_tokens(now, loras), text)), text
    plan = index.tokens(spark, "violet sk")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_selection_by_list_or_table(spark):
    hashes = ["a" * 32, "b" * 32, "c" * 32]
    images = spark.createDataFrame([(h,) for h in hashes], "hash string")
    table = lambda *picked: spark.createDataFrame([(p,) for p in picked], "hash string")
    for picked, want in ((hashes[:2], hashes[:2]), ([hashes[2], "bad"], hashes[2:]), (["bad"], hashes), ([], hashes)):
        assert hits(cat.f_selection(images, picked)) == hits(cat.f_selection(images, table(*picked, *picked))) == want
