"""Generation metadata held in text chunks: parameter blocks, comment JSON, dispatch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import bind, trim_space

LORA = "struct<name:string,weight:double>"
PARSED = f"struct<generator:string,prompt:string,negative_prompt:string,checkpoint:string,model_hash:string,loras:array<{LORA}>,params:map<string,string>,extra:map<string,string>>"


def capped(c: Column, n: int = fv.MAX_PROMPT_CHARS) -> Column:
    return F.substring(trim_space(F.coalesce(c, F.lit(""))), 1, n)


def webui_flavor(version: Column) -> Column:
    return F.when(F.coalesce(version.rlike("(?i)reforge"), F.lit(False)), "reforge").when(F.coalesce(version.rlike(r"^f\d"), F.lit(False)), "forge").otherwise("webui")


def relax_json(c: Column) -> Column:
    """Null instead of bare NaN and Infinity; the same words inside strings stay.

    The text is cut into strings and the parts between; only the parts are changed."""
    pieces = F.regexp_extract_all(c, F.lit(r'("(?:[^"\\]|\\.)*+"|[^"]+|")'), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(F.regexp_replace(p, r"(^|[:\[,]\s*)-?\b(?:NaN|Infinity)\b", "$1null"))), "")


def split_fields(line: Column) -> Column:
    """Comma-separated fields; commas inside double quotes do not split."""
    raw = F.regexp_extract_all(line, F.lit(r'((?:[^,"]|"[^"]*(?:"|$))+)'), F.lit(1))
    return F.filter(F.transform(raw, lambda f: trim_space(f)), lambda f: f != "")


def _entries(line: Column) -> Column:
    def entry(field: Column) -> Column:
        at = F.instr(field, ":")
        return F.struct(trim_space(F.substring(field, F.lit(1), at - 1)).alias("key"), trim_space(F.substring(field, at + 1, F.length(field))).alias("value"))

    return F.transform(F.filter(split_fields(line), lambda f: F.contains(f, F.lit(":"))), entry)


def parse_param_fields(line: Column) -> Column:
    """Known parameters (canonical names, coerced) and the rest as ``extra``."""
    names = F.create_map(*[F.lit(x) for pair in fv.PARAM_NAMES.items() for x in pair])
    known = F.array(*[F.lit(k) for k in fv.PARAM_NAMES])

    def coerce(e: Column) -> Column:
        name = F.try_element_at(names, F.lower(e["key"]))
        value = F.regexp_replace(e["value"], '^"|"$', "")
        whole = F.nullif(F.regexp_extract(value, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint").cast("string")
        real = F.nullif(F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double").cast("string")
        return F.struct(name.alias("key"), F.when(name.isin(fv.INT_PARAMS), whole).when(name.isin(fv.FLOAT_PARAMS), real).otherwise(value).alias("value"))

    def judge(entries: Column) -> Column:
        good = F.filter(F.transform(F.filter(entries, lambda e: F.array_contains(known, F.lower(e["key"]))), coerce), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
        other = F.filter(entries, lambda e: ~F.array_contains(known, F.lower(e["key"])))
        return F.struct(_last_wins(good).alias("params"), _last_wins(other).alias("extra"))

    return bind(_entries(line), judge)


def _last_wins(entries: Column) -> Column:
    def of(given: Column) -> Column:
        keys = F.array_distinct(F.transform(given, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(given, lambda e: e["key"] == k), -1)["value"]))

    return bind(entries, of)


def unique_loras(loras: Column) -> Column:
    """First entry per name; loader placeholders are no styles."""
    clean = F.filter(F.transform(F.coalesce(loras, F.array().cast(f"array<{LORA}>")), lambda x: F.struct(F.substring(trim_space(x["name"]), 1, 300).alias("name"), x["weight"].alias("weight"))),
                     lambda x: ~F.lower(x["name"]).isin(fv.LORA_PLACEHOLDERS))
    return bind(clean, lambda given: F.transform(F.array_distinct(F.transform(given, lambda x: x["name"])), lambda n: F.get(F.filter(given, lambda x: x["name"] == n), F.lit(0))))


def loras(prompt: Column, hashes: Column) -> Column:
    """Inline ``<lora:name:weight>`` tags, then the names of the hash list."""
    tags = F.regexp_extract_all(prompt, F.lit(r"(?i)(<lora:[^:>]+(?::[\d.]+)?[^>]*>)"), F.lit(1))
    inline = F.transform(tags, lambda t: F.struct(trim_space(F.regexp_extract(t, r"(?i)<lora:([^:>]+)", 1)).alias("name"),
                                                  F.nullif(F.regexp_extract(t, r"(?i)<lora:[^:>]+:([\d.]+)", 1), F.lit("")).try_cast("double").alias("weight")))
    listed = F.split(F.regexp_replace(trim_space(F.coalesce(hashes, F.lit(""))), '^"|"$', ""), ",")
    named = F.transform(F.filter(F.transform(listed, lambda e: trim_space(F.split(e, ":")[0])), lambda n: n != ""), lambda n: F.struct(n.alias("name"), F.lit(None).cast("double").alias("weight")))
    return unique_loras(F.concat(inline, named))


def parse_params_block(block: Column) -> Column:
    """Prompt, negative prompt and the parameters of the last line."""
    def cut(lines: Column) -> Column:
        last = F.element_at(lines, -1)
        has = last.rlike(fv.PARAM_LINE)
        body = F.array_join(F.when(has, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), "\n")
        return F.struct(body.alias("body"), F.when(has, last).otherwise("").alias("line"))

    def judge(c: Column) -> Column:
        head = F.regexp_replace(c["body"], r"(?sm)^Negative prompt:.*\z", "")
        negative = F.when(c["body"].rlike(r"(?m)^Negative prompt:"), F.regexp_extract(c["body"], r"(?sm)^Negative prompt:\s*(.*)\z", 1)).otherwise("")
        return bind(parse_param_fields(c["line"]), lambda f: F.struct(
            webui_flavor(F.try_element_at(f["params"], F.lit("version"))).alias("generator"), capped(head).alias("prompt"), capped(negative).alias("negative_prompt"),
            capped(F.try_element_at(f["params"], F.lit("model")), 300).alias("checkpoint"), capped(F.try_element_at(f["params"], F.lit("modelHash")), 64).alias("model_hash"),
            loras(head, F.try_element_at(f["params"], F.lit("loraHashes"))).alias("loras"), f["params"].alias("params"), f["extra"].alias("extra")))

    return bind(bind(F.split(block, r"\r?\n"), cut), judge)


def parse_comment_json(chunks: Column) -> Column:
    """Comment-JSON producer; the description stands in for a missing prompt."""
    at = lambda k: F.try_element_at(chunks, F.lit(k))

    def judge(comment: Column) -> Column:
        text = lambda k: F.get_json_object(comment, f"$.{k}")
        pairs = [F.struct(F.lit(target).alias("key"), text(source).alias("value")) for source, target in fv.COMMENT_PARAMS.items()]
        size = F.when(text("width").try_cast("double").isNotNull() & text("height").try_cast("double").isNotNull(), F.concat(text("width"), F.lit("x"), text("height")))
        kept = F.filter(F.array(*pairs, F.struct(F.lit("size").alias("key"), size.alias("value"))), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
        own = capped(text("prompt"))
        return F.struct(F.lit("nai").alias("generator"), F.when(own != "", own).otherwise(capped(at("Description"))).alias("prompt"), capped(text("uc")).alias("negative_prompt"),
                        capped(at("Source"), 300).alias("checkpoint"), F.lit("").alias("model_hash"), F.array().cast(f"array<{LORA}>").alias("loras"), F.map_from_entries(kept).alias("params"),
                        F.create_map().cast("map<string,string>").alias("extra"))

    return bind(F.coalesce(relax_json(at("Comment")), F.lit("{}")), judge)


def detect_metadata(chunks: Column, graph: Column | None = None) -> Column:
    """Producer of an image by its chunks: comment JSON, then the parameter block, then the
    workflow graph (``graph``: an already resolved struct, see operators.graph)."""
    at = lambda k: F.try_element_at(chunks, F.lit(k))
    block = F.coalesce(at("parameters"), at("UserComment"), at("ImageDescription"))
    told = F.contains(F.coalesce(at("Software"), F.lit("")), F.lit("NovelAI")) | at("Comment").isNotNull()
    usable = [F.when(told, bind(parse_comment_json(chunks), lambda c: F.when(c["prompt"] != "", c))),
              F.when(trim_space(block) != "", bind(parse_params_block(block), lambda p: F.when((p["prompt"] != "") | (F.size(p["params"]) > 0), p)))]
    if graph is not None:
        usable.append(F.when((graph["prompt"] != "") | (F.size(graph["loras"]) > 0), graph))
    return bind(F.coalesce(*usable), lambda f: F.when(f.isNotNull(), f.withField(
        "negative_prompt", F.when(f["negative_prompt"] == f["prompt"], "").otherwise(f["negative_prompt"])).withField("loras", unique_loras(f["loras"]))))


def raw_chunks(chunks: Column) -> Column:
    return F.transform_values(chunks, lambda k, x: F.substring(x, 1, fv.MAX_CHUNK_CHARS))
