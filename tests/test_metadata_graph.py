import json

from pyspark.sql import functions as F

from colloquia.functions import params as pm
from colloquia.operators import graph as gr
from colloquia.operators.harvest import parse_originals


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


BLOCK = 'a cat <lora:Fur:0.6>\nmore, <lora:none:1>\nNegative prompt: bad,\nworse\nSteps: 20, Sampler: DPM++ 2M, CFG scale: 7.5, Seed: 99, Lora hashes: "Fur: 1a, Other: 2b", Odd key: x, Version: f2.0'


def test_parameter_block(spark):
    got = one(spark, BLOCK, pm.parse_params_block)
    assert (got.generator, got.prompt, got.negative_prompt) == ("forge", "a cat <lora:Fur:0.6>\nmore, <lora:none:1>", "bad,\nworse")
    assert got.params["steps"] == "20" and got.params["cfgScale"] == "7.5" and got.params["loraHashes"] == "Fur: 1a, Other: 2b" and got.extra == {"Odd key": "x"}
    assert [(x.name, x.weight) for x in got.loras] == [("Fur", 0.6), ("Other", None)]
    plain = one(spark, "just text\nno parameters", pm.parse_params_block)
    assert plain.prompt == "just text\nno parameters" and plain.params == {} and plain.negative_prompt == ""


def test_bare_nan_becomes_null_outside_strings(spark):
    assert json.loads(one(spark, '{"a": NaN, "b": "x NaN \\" : NaN", "c": [-Infinity, 1]}', pm.relax_json)) == {"a": None, "b": 'x NaN " : NaN', "c": [None, 1]}


def chunks(spark, **cases):
    rows = [(k, "f/" + k, 1, 1, v) for k, v in cases.items()]
    return spark.createDataFrame(rows, "hash string, file_path string, file_size long, file_mtime long, chunks map<string,string>")


GRAPH = {
    "1": {"class_type": "Odd Sampler", "inputs": {"positive": ["9", 0], "negative": ["9", 0]}},
    "2": {"class_type": "KSampler", "inputs": {"positive": ["3", 0], "negative": ["5", 0], "steps": 12, "cfg": 4.5, "seed": 12345678901234567, "denoise": float("nan")}},
    "3": {"class_type": "Pass", "inputs": {"zeta": ["4", 0], "conditioning": ["6", 0]}},
    "4": {"class_type": "Text", "inputs": {"text": "wrong branch"}},
    "5": {"class_type": "Text", "inputs": {"text": "ugly"}},
    "6": {"class_type": "Loop", "inputs": {"a": ["3", 0], "b": ["7", 0]}},
    "7": {"class_type": "Text", "inputs": {"temp_str": "[1]", "populated_text": "a dog"}},
    "9": {"class_type": "Model", "inputs": {"ckpt_name": "ComfyUI_0001.safetensors", "unet_name": "real.safetensors"}},
    "10": {"class_type": "Size", "inputs": {"width": 640, "height": 480}},
}


def test_dispatch_and_graph(spark):
    rows = {r.hash: r for r in parse_originals(chunks(
        spark, a={"parameters": BLOCK, "workflow": "{}"}, b={"Comment": '{"prompt":"nai text","uc":"nai text","scale":NaN,"steps":28,"width":1,"height":2}', "Source": "m"}, c={"prompt": json.dumps(GRAPH)},
        d={"Title": "none"}, e={"prompt": "{broken", "workflow": json.dumps({"nodes": [{"type": "LoraLoader", "widgets_values": ["x.safetensors", 1]}, {"type": "CLIPTextEncode", "widgets_values": ["long enough text"]}]})},
        f={"Comment": "{}", "Description": "from description"})).collect()}
    assert (rows["a"].generator, rows["b"].generator, rows["c"].generator, rows["d"].generator, rows["e"].generator, rows["f"].generator) == ("forge", "nai", "comfyui", "unknown", "comfyui", "nai")
    assert rows["b"].prompt == "nai text" and rows["b"].negative_prompt == "" and json.loads(rows["b"].params_json) == {"steps": "28", "size": "1x2"}
    assert (rows["c"].prompt, rows["c"].negative_prompt, rows["c"].checkpoint) == ("a dog", "ugly", "real.safetensors")
    assert json.loads(rows["c"].params_json) == {"steps": "12", "cfgScale": "4.5", "seed": "12345678901234567", "size": "640x480"}
    assert rows["e"].prompt == "long enough text" and [x.name for x in rows["e"].loras] == ["x.safetensors"] and rows["f"].prompt == "from description"


def test_link_order_and_cycles(spark):
    df = spark.createDataFrame([("g", json.dumps(GRAPH))], "hash string, graph string")
    inputs = gr.graph_inputs(df)
    roots = spark.createDataFrame([("g", "r3", "3"), ("g", "r9", "9"), ("g", "r6", "6")], "hash string, root string, node_id string")
    assert {r.root: r.text for r in gr.resolve_text(inputs, roots).collect()} == {"r3": "a dog", "r6": "wrong branch"}
    edges = [(r.node_id, r.key) for r in gr.edges_of(inputs).filter("node_id = '3'").orderBy("edge_ord").collect()]
    assert edges == [("3", "conditioning"), ("3", "zeta")]


def test_links_are_followed_in_order_through_cycles_and_not_too_far():
    from colloquia.operators.graph import first_literal
    links = {"a": ["b", "c"], "b": ["a", "d"], "c": ["e"]}
    assert first_literal("a", {"e": "late"}, links) == "late"
    assert first_literal("a", {"d": "early", "e": "late"}, links) == "early"
    assert first_literal("a", {}, links) is None
    chain = {str(i): [str(i + 1)] for i in range(40)}
    assert first_literal("0", {"16": "near"}, chain) == "near" and first_literal("0", {"30": "far"}, chain) is None
    ladder = {str(i): [str(i + 1), str(i + 2), "0"] for i in range(16)}  # many paths, little work
    assert first_literal("0", {"17": "top"}, ladder) == "top"
