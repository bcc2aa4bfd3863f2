from pyspark.sql import functions as F

from colloquia.operators import catalog, export, harvest, pairing, upserts
from colloquia.operators.media import upsert_reviews

PROMPT = "masterpiece, best quality, 1girl, solo, "
MSG = "group_id string, row_id string, sent_at long, sender string, speaker string, input_order long, text string"
REF = "group_id string, row_id string, sent_at long, sender string, speaker string, input_order long, kind string, hash string, file_name string"
QUOTE = "group_id string, row_id string, quoted_hashes array<string>"


def h(x):
    return x * 32


def pairs(spark, messages, refs, quotes=()):
    texts = spark.createDataFrame([("g", str(i), t, who, f"n{who}", i, text) for i, (t, who, text) in enumerate(messages)], MSG)
    media = spark.createDataFrame([("g", f"m{i}", t, who, f"n{who}", i, kind, digest, "") for i, (t, who, kind, digest) in enumerate(refs)], REF)
    links = spark.createDataFrame([("g", row, [digest]) for row, digest in quotes], QUOTE)
    return {r.ask_row_id: r for r in pairing.pair_requests(texts, media, links).collect()}


def test_quoted_target_stays_even_when_another_person_answers(spark):
    got = pairs(spark, [(100, "a", "kkt"), (150, "c", PROMPT + "x")], [(50, "b", "image", h("1"))], [("0", h("1"))])["0"]
    assert (got.target_via, got.confidence, got.image_hash, got.image_owner, got.answer_by, got.answer_kind) == ("quote", "high", h("1"), "nb", "nc", "text")
    lost = pairs(spark, [(100, "a", "kkt")], [(50, "b", "image", h("1"))], [("0", h("2"))])["0"]
    assert (lost.target_via, lost.confidence, lost.image_hash, lost.answer_kind) == ("quote-unresolved", "medium", h("2"), "")


def test_answer_author_evidence(spark):
    one = pairs(spark, [(2000, "a", "kkt"), (2100, "b", PROMPT)], [(300, "b", "image", h("1")), (1950, "c", "image", h("2"))])["0"]
    assert (one.target_via, one.confidence, one.image_hash) == ("answer-author", "medium", h("1"))
    many = pairs(spark, [(2000, "a", "kkt"), (2100, "b", PROMPT)], [(300, "b", "image", h("1")), (900, "b", "image", h("2")), (1999, "c", "image", h("3"))])["0"]
    assert (many.target_via, many.confidence, many.image_hash) == ("answer-author-multiple", "low", h("2"))


def test_guess_only_when_alone_and_withdrawn_on_contradiction(spark):
    alone = pairs(spark, [(2000, "a", "kkt")], [(1900, "b", "image", h("1"))])["0"]
    assert (alone.target_via, alone.confidence, alone.image_hash) == ("recent-unambiguous", "low", h("1"))
    crowd = pairs(spark, [(2000, "a", "kkt")], [(1900, "b", "image", h("1")), (1901, "b", "image", h("2"))])["0"]
    assert (crowd.target_via, crowd.confidence, crowd.image_hash) == ("none", "none", None)
    against = pairs(spark, [(2000, "a", "kkt"), (2050, "c", PROMPT)], [(1900, "b", "image", h("1"))])["0"]
    assert (against.target_via, against.confidence, against.image_hash, against.answer_by) == ("guess-contradicted", "none", None, "nc")


def test_original_requests_take_media_only_and_ignore_its_sender_as_evidence(spark):
    got = pairs(spark, [(2000, "a", "kko"), (2010, "b", PROMPT)], [(1950, "c", "image", h("1")), (2030, "a", "image", h("4")), (2060, "d", "file", h("5")), (2000, "b", "video", h("6"))])["0"]
    assert (got.answer_kind, got.answer_by, [m.hash for m in got.answer_media], got.answer_sent_at) == ("media", "nd", [h("5")], 2060)
    assert (got.target_via, got.image_hash) == ("recent-unambiguous", h("1"))
    late = pairs(spark, [(2000, "a", "kko")], [(2121, "d", "image", h("5"))])["0"]
    assert late.answer_kind == "" and late.answer_text == ""


def test_same_second_answer_counts_and_own_answer_does_not(spark):
    got = pairs(spark, [(100, "b", PROMPT + "early"), (100, "a", "kkt"), (101, "a", PROMPT + "own")], [(1, "z", "video", h("9"))])["1"]
    assert got.answer_text.endswith("early")


def test_image_first_posted_in_another_group_is_no_candidate(spark):
    texts = spark.createDataFrame([("g", "1", 100, "a", "na", 1, "kkt")], MSG)
    media = spark.createDataFrame([("h", "1", 10, "b", "nb", 1, "image", h("1"), ""), ("g", "2", 90, "c", "nc", 2, "image", h("1"), "")], REF)
    got = pairing.pair_requests(texts, media, spark.createDataFrame([], QUOTE)).first()
    assert got.target_via == "none"


def test_one_busy_second_stays_linear_and_exact(spark):
    """A third of all rows in one second of one group: asks and answers both crowd there."""
    asks = [(500, f"a{i}", "kkt") for i in range(300)]
    answers = [(500, f"a{i % 40}", PROMPT + str(i)) for i in range(300)]
    got = pairs(spark, asks + answers, [(1, "z", "video", h("9"))])
    assert len(got) == 300
    for i in range(300):
        want = next(j for j in range(300) if f"a{j % 40}" != f"a{i}")
        assert got[str(i)].answer_text == (PROMPT + str(want)).strip()


def test_request_merge_keeps_answers_and_images(spark):
    schema = ("group_id string, ask_row_id string, ask_sent_at long, group_name string, intent string, rule string, asker string, ask_text string, image_hash string, image_owner string, image_sent_at long, "
              "target_via string, confidence string, answer_text string, answer_kind string, answer_media array<struct<hash:string>>, answer_by string, answer_sent_at long")
    old = spark.createDataFrame([("g", "1", 5, "name", "prompt", "kk:t", "a", "kkt", "img", "own", 9, "quote", "high", "text", "text", [], "b", 7)], schema)
    new = spark.createDataFrame([("g", "1", 6, "", "prompt", "exact", "a2", "kkt", None, "", 0, "none", "none", "", "", [], "", 0), ("g", "2", 6, "n", "prompt", "exact", "a", "t", None, "", 0, "none", "none", "", "", [], "", 0)], schema).withColumn("seq", F.lit(1))
    got = {r.ask_row_id: r for r in upserts.upsert_requests(old, new).collect()}
    assert (got["1"].image_hash, got["1"].answer_text, got["1"].answer_by, got["1"].confidence, got["1"].group_name, got["1"].rule, got["1"].image_sent_at, got["1"].ask_sent_at) == ("img", "text", "b", "none", "name", "exact", 9, 5)
    assert len(got) == 2


def test_review_patches(spark):
    schema = "event_id string, status string, favorite boolean, note string"
    current = spark.createDataFrame([("e1", "reviewed", True, "n")], schema)
    patches = spark.createDataFrame([("e1", 1, None, False, None), ("e2", 1, "follow-up", None, None)], "event_id string, seq long, status string, favorite boolean, note string")
    assert sorted(tuple(r) for r in upsert_reviews(current, patches).collect()) == [("e1", "reviewed", False, "n"), ("e2", "follow-up", False, "")]


def test_media_verdicts(spark):
    entries = spark.createDataFrame([(h("a"), "p/a", "downloaded", 1), (h("b"), None, "downloaded", 2), (h("c"), "p/c", "downloaded", 3), (h("d"), "p/d", "not-found", 4), (h("e"), "p/e", "x", 5), (h("f"), None, "x", 6), (h("0"), None, "x", 7)],
                                    "hash string, copied_path string, remote_status string, position long")
    images = spark.createDataFrame([(h("e"), "stripped"), (h("f"), "webui"), (h("0"), "webui")], "hash string, generator string")
    objects = spark.createDataFrame([(h("0"), "o/0")], "hash string, object_path string")
    files = spark.createDataFrame([("p/a", h("a"), "webui"), ("p/c", h("1"), "webui"), ("p/d", h("d"), "webui"), ("p/e", h("e"), "nai")], "path string, md5 string, generator string")
    got = {r.hash[0]: (r.status, r.change) for r in upserts.reconcile_media(entries, images, objects, files).collect()}
    assert got == {"a": ("stored", "discovered"), "b": ("untracked", "none"), "c": ("hash-mismatch", "none"), "d": ("untracked", "none"), "e": ("stored", "upgraded"), "f": ("source-missing", "none"), "0": ("reused", "none")}


def test_text_search_prefixes_and_folding(spark):
    images = spark.createDataFrame([("1", "Café Étoile", "", "m"), ("2", "cafeteria", "", "m"), ("3", "初音未来", "", "m")], "hash string, prompt string, negative_prompt string, checkpoint string")
    tokens = catalog.search_tokens(images, spark.createDataFrame([("2", "style_one")], "hash string, lora_name string"))
    found = lambda q: {r.hash for r in catalog.f_text(images, tokens, q).collect()}
    assert found("caf") == {"1", "2"} and found("cafe eto") == {"1"} and found("初音") == {"3"} and found("未来") == set() and found("style caf") == {"2"} and found("!!") == {"1", "2", "3"}


def test_stems_and_ledger(spark):
    items = spark.createDataFrame([("1", "Ab"), ("2", "aB"), ("3", "c")], "hash string, stem string")
    assert {r.hash: r.stem for r in export.dedupe_stems(items, ["hash"]).collect()} == {"1": "Ab", "2": "aB_2", "3": "c"}
    ledger = spark.createDataFrame([("1",)], "hash string")
    assert {r.hash for r in export.plan_export(items, ledger).collect()} == {"2", "3"} and export.plan_export(items, ledger, "all").count() == 3
    assert tuple(export.preview_export(items, ledger).first()) == (2, 1) and export.forget(ledger).count() == 0
    many = spark.createDataFrame([(f"{i:03d}",) for i in range(100)], "path string")
    assert sorted(r.path for r in export.stride_sample(many, ["path"], 30).collect()) == [f"{i:03d}" for i in range(0, 90, 3)]


def test_harvest_twice_changes_nothing(spark):
    texts = spark.createDataFrame([("g", "1", 100, "a", "na", 1, "kkt"), ("g", "2", 150, "b", "nb", 2, PROMPT + "x")], MSG)
    media = spark.createDataFrame([("g", "3", 50, "b", "nb", 1, "image", h("a"), "p.png"), ("g", "4", 60, "c", "nc", 2, "image", h("b"), "q.png")], REF)
    quotes = spark.createDataFrame([("g", "1", [h("b")])], QUOTE)
    files = spark.createDataFrame([(f"Pic/Ori/{h('a')}.png",)], "path string")
    chunks = spark.createDataFrame([(h("a"), "f/a", 1, 1, {"parameters": "a cat <lora:thin:0.5>\nSteps: 3, Sampler: x"})], "hash string, file_path string, file_size long, file_mtime long, chunks map<string,string>")
    none = lambda ddl: spark.createDataFrame([], ddl)
    store = {"images": none("hash string, file_path string, file_size long, file_mtime long, generator string, prompt string, negative_prompt string, checkpoint string, params_json string, parsed_at long, file_missing long, object_path string"),
             "sightings": none("hash string, group_id string, row_id string, sent_at long, speaker string, speaker_uin string, group_name string"), "scan_state": none("file_path string, file_size long, file_mtime long, parser_version long"),
             "requests": none("group_id string, ask_row_id string, ask_sent_at long, group_name string, intent string, rule string, asker string, ask_text string, image_hash string, image_owner string, image_sent_at long, target_via string, confidence string, "
                              "answer_text string, answer_kind string, answer_media array<struct<kind:string,hash:string,file_name:string>>, answer_by string, answer_sent_at long")}
    first = harvest.harvest(texts, media, quotes, files, chunks, store, 9)
    images = {r.hash: (r.generator, r.prompt) for r in first["images"].collect()}
    assert images == {h("a"): ("webui", "a cat <lora:thin:0.5>"), h("b"): ("stripped", "")}
    assert {r.counter: r.value for r in first["stats"].collect()} == {"image_refs": 2, "original_missing": 1, "parsed": 1, "stripped": 0, "skipped": 0, "attributed": 1, "requests": 1, "answered_requests": 1, "placeholders": 1}
    again = {k: first[k] for k in ("images", "sightings", "requests", "scan_state", "loras")}
    second = harvest.harvest(texts, media, quotes, files, chunks, again, 10)
    assert {r.hash: (r.generator, r.prompt) for r in second["images"].collect()} == images
    assert second["sightings"].count() == first["sightings"].count() == 2 and second["requests"].count() == 1
    assert {r.counter: r.value for r in second["stats"].collect()}["skipped"] == 1
    for part in ("scan_state", "loras"):
        assert sorted(map(tuple, first[part].collect())) == sorted(map(tuple, second[part].collect())) and first[part].count() == 1


def test_upsert_keeps_stored_image_columns(spark):
    stored = spark.createDataFrame([("a", "p", "webui", 1, 1, "o", 640, "raw"), ("b", "q", "nai", 1, 0, "", 512, None)], "hash string, file_path string, generator string, parsed_at long, file_missing long, object_path string, width long, chunks string")
    delta = spark.createDataFrame([("a", "new", "forge", 5), ("c", "c", "nai", 5)], "hash string, file_path string, generator string, parsed_at long")
    got = {r.hash: (r.file_path, r.width, r.chunks, r.file_missing, r.object_path) for r in upserts.upsert_images(stored, delta).collect()}
    assert got == {"a": ("new", 640, "raw", 0, "o"), "b": ("q", 512, None, 0, ""), "c": ("c", None, None, 0, "")}
