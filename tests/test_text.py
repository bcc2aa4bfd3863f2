import pytest
from pyspark.sql import functions as F

from colloquia.functions import asks, media, text, values
from colloquia.operators import content


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("\ufffd a\x07  b\n", "a b"), ("  ", ""), ("x\ty", "x\ty"), ("\u3000谢谢\u00a0", "谢谢")])
def test_light_clean(spark, raw, want):
    assert one(spark, raw, text.light_clean) == want


def test_snippet_keeps_readable_parts_only(spark):
    assert one(spark, "\x00ab 今天天气，qZxWvY hello 42 7 \ufffdrhythm-less", text.sanitize_snippet) == "今天天气， hello 42 rhythm-less"
    assert one(spark, "ab", text.sanitize_snippet) == ""


def test_tokens_of_mixed_text(spark):
    assert one(spark, "显卡驱动 GPU gpu the 12 2024 我们 a-b_c", text.tokens) == ["显卡驱动", "gpu", "gpu", "2024", "a-b_c"]


def test_urls_stop_at_full_width_bracket(spark):
    assert one(spark, "看（https://a.cn/x?y=1）和 http://b.c'", text.extract_urls) == ["https://a.cn/x?y=1", "http://b.c"]


def test_tags(spark):
    assert one(spark, r"(long hair:1.2), {{Smile}}, <lora:x:1> miku \(vocaloid\), smile,,long  hair", text.tags_from_prompt) == ["long hair", "smile", "miku vocaloid"]


def test_stem_and_csv_guards(spark):
    assert one(spark, "CON", text.sanitize_stem) == "image"
    assert one(spark, 'a<b>: c. .', text.sanitize_stem) == "a_b__ c"
    assert one(spark, "=1+1", text.csv_cell) == "'=1+1" and one(spark, "1=1", text.csv_cell) == "1=1"


@pytest.mark.parametrize("raw, quote, want", [
    ("kkt", False, ("prompt", "kk:t")), ("KKO", False, ("original", "kk:o")), ("kkt康康", False, ("prompt", "kk:t")), ("kkt是什么", True, None), ("kktx", False, None),
    ("原图呢？", False, ("original", "exact")), ("这是原图", True, None), ("求一下咒语", False, ("prompt", "exact")), ("康康！", False, ("prompt", "exact")), ("看看tag", False, ("prompt", "exact")),
    ("大佬，发我一张原图", True, ("original", "contextual")), ("大佬，发我一张原图", False, None), ("截图比你发我原图还清晰", True, None), ("\x06kkp", False, ("prompt", "kk:p")), ("", False, None),
])
def test_ask_classifier(spark, raw, quote, want):
    got = one(spark, raw, lambda c: asks.classify_ask(c, F.lit(quote)))
    assert (None if got is None else (got.intent, got.rule)) == want


@pytest.mark.parametrize("raw, want", [
    ("masterpiece, best quality, 1girl, solo, looking at viewer", True), ("Steps: 20, Sampler: Euler, CFG scale: 7", True), ("short, text", False),
    ("今天天气很好，我们一起去公园吧，你觉得怎么样？ masterpiece, solo, 1girl", False), ("one thing, another thing, a third thing, and a fourth", False), ("masterpiece best quality 1girl solo portrait", False),
])
def test_prompt_shape(spark, raw, want):
    assert one(spark, raw, asks.looks_like_prompt) is want


def test_local_time_round_trip(spark):
    assert spark.range(1).select(values.to_local(F.lit(1704067200)).alias("x")).first().x == "2024-01-01 08:00:00"
    assert one(spark, "2024-01-01 08:00:00", values.from_local) == 1704067200
    assert one(spark, "2024-13-01 08:00:00", values.from_local) is None
    assert one(spark, "run-20240101-080000", values.run_created) == 1704067200
    span = spark.range(1).select(values.evidence_range(F.array(F.lit("[2024-01-01 08:00] a"), F.lit("none"))).alias("x")).first().x
    assert (span.from_unix, span.to_unix) == (1704066600, 1704067800)


@pytest.mark.parametrize("size, want", [(0, "0 B"), (512, "512 B"), (1536, "1.50 KB"), (5 * 1024 ** 3, "5.00 GB")])
def test_bytes(spark, size, want):
    assert spark.range(1).select(values.format_bytes(F.lit(size)).alias("x")).first().x == want


def test_media_refs_in_order_without_repeats(spark):
    digest = "0123456789abcdef0123456789ABCDEF"
    body = f"D:\\chat\\Pic\\{digest}.png and {{01234567-89ab-cdef-0123-456789abcdef}}.MP4 then https://x.y/a.jpg?z=1 https://x.y/page D:\\c\\Emoji\\s.gif {digest}.png"
    refs = one(spark, body, media.media_refs)
    assert [(r.source, r.kind, r.hash) for r in refs] == [
        ("localPath", "image", digest.lower()), ("localPath", "emoji", None), ("fileToken", "image", digest.lower()), ("fileToken", "video", "0123456789abcdef0123456789abcdef"), ("url", "image", None)]
    assert refs[0].file_name == f"{digest}.png" and refs[4].url == "https://x.y/a.jpg?z=1"


def test_media_formatting(spark):
    schema = "refs array<struct<source:string,kind:string,extension:string,hash:string,file_name:string,local_path:string,url:string>>"
    refs = [("", "image", "", None, "A.png", None, None), ("", "image", "", None, "a.PNG", None, None), ("", "video", "", "ff", None, None, None)]
    df = spark.createDataFrame([(refs,)], schema)
    assert df.select(media.format_refs(F.col("refs")).alias("x")).first().x == "image:a.PNG; video:ff"
    assert tuple(df.select(media.media_text(F.col("refs"), F.lit("\x01")).alias("x")).first().x) == ("image,video", "A.png")
    assert [r.file_name for r in df.select(media.reply_media(F.col("refs")).alias("x")).first().x] == ["A.png", "a.PNG"]


def test_token_stats_counts_messages_once(spark):
    df = spark.createDataFrame([("g", "1", "显卡 显卡 显卡"), ("g", "2", "hello you"), ("g", "3", "hello")], "group_id string, row_id string, text string")
    assert {(r.token, r["count"], r.messages) for r in content.token_stats(df).collect()} == {("显卡", 3, 1), ("hello", 2, 2)}


def test_time_blocks_break_after_half_an_hour(spark):
    df = spark.createDataFrame([("g", 0, "a"), ("g", 1800, "b"), ("g", 3601, "a")], "group_id string, sent_at long, speaker string")
    assert sorted((r.start_unix, r.end_unix, r.message_count, r.top_speakers) for r in content.time_blocks(df).collect()) == [(0, 1800, 2, "a:1,b:1"), (3601, 3601, 1, "a:1")]


def test_signals(spark):
    df = spark.createDataFrame([("g", "1", 1, 1, "麻烦看看"), ("g", "2", 2, 2, "又报错 TIMEOUT"), ("g", "3", 3, 3, "hi")], "group_id string, row_id string, sent_at long, input_order long, text string")
    assert {(r.row_id, r.signal) for r in content.signals(df).collect()} == {("1", "action"), ("2", "risk")}
