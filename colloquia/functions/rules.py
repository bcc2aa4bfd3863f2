"""Rule tables: what the classifiers and the signal search look for, as rows.

A rule has a set (``ask``, ``answer`` or ``signal``), a position that orders it in its set, a kind, a
pattern and a value. Kinds: ``short``, ``exact``, ``contextual`` (value: intent) and ``comment`` of asks;
``marker``, ``vocabulary`` and ``hint`` of answers; ``plain`` and ``folded`` (value: signal) of signals.
Signal patterns are words, short patterns are letters and hints are lower-case words; all others are
regular expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquia import fixed_values as fv

KINDS = {"ask": ("short", "exact", "contextual", "comment"), "answer": ("marker", "vocabulary", "hint"), "signal": ("plain", "folded")}
SCHEMA = "ruleset string, position int, kind string, pattern string, value string"
MAX_RULES = 10_000


class Rule(NamedTuple):
    ruleset: str
    position: int
    kind: str
    pattern: str
    value: str


def default_rules(ruleset: str) -> list[Rule]:
    """The rules that apply where no table is given."""
    listed = {
        "ask": [*(("short", p, i) for p, i in fv.SHORT_ASK_INTENT.items()), *(("exact", p, i) for p, i in fv.EXACT_ASKS),
                *(("contextual", p, i) for p, i in fv.CONTEXTUAL_ASKS), *(("comment", p, "") for p in fv.NOT_AN_ASK)],
        "answer": [("marker", fv.PARAMETER_MARKERS, ""), *(("vocabulary", p, "") for p in fv.PROMPT_VOCABULARY), *(("hint", p, "") for p in fv.PROMPT_HINTS)],
        "signal": [*(("plain", w, "action") for w in fv.ACTION_WORDS), *(("folded", w, "risk") for w in fv.RISK_WORDS)],
    }[ruleset]
    return [Rule(ruleset, i, *rest) for i, rest in enumerate(listed)]


def rule_table(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rules as a table; all default rules if none are given."""
    rows = [r for s in KINDS for r in default_rules(s)] if rules is None else list(rules)
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def read_rules(table: DataFrame | None, ruleset: str, most: int = MAX_RULES) -> list[Rule]:
    """The rules of one set in order, equal positions by kind, pattern and value; the default rules if
    ``table`` is None. Rules become part of a plan, so more than ``most`` of them, unknown kinds and
    empty patterns are errors."""
    if table is None:
        return default_rules(ruleset)
    rows = table.filter(F.col("ruleset") == ruleset).select(*Rule._fields).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules in set {ruleset}")
    found = sorted((Rule(r.ruleset, r.position or 0, r.kind or "", r.pattern or "", r.value or "") for r in rows), key=lambda r: r[1:])
    wrong = [r for r in found if r.kind not in KINDS[ruleset] or not r.pattern]
    if wrong:
        raise ValueError(f"not a rule of set {ruleset}: {wrong[0]}")
    return found


def of_kind(rules: Sequence[Rule], kind: str) -> list[Rule]:
    return [r for r in rules if r.kind == kind]


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def signals_of(messages: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``keys`` of the messages that hold a signal word, with the array of their signals.

    All words form one automaton, which reads every text once (in Arrow batches; the texts do not
    come back). Words that must stand in their own case and have one are in a second automaton
    over the text as it is.
    """
    names = sorted({r.value for r in rules})
    bit = {name: 1 << i for i, name in enumerate(names)}
    folded: dict[str, int] = {}
    plain: dict[str, int] = {}
    for rule in rules:
        caseless = rule.pattern.lower() == rule.pattern.upper() and "\u0307" not in rule.pattern  # lower-casing can add this mark
        words = folded if rule.kind == "folded" or caseless else plain
        words[rule.pattern] = words.get(rule.pattern, 0) | bit[rule.value]
    everything = (1 << len(names)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        def automaton(words):
            machine = ahocorasick.Automaton()
            for word, mask in words.items():
                machine.add_word(word, mask)
            machine.make_automaton()
            return machine

        machines = [(automaton(words), lower) for words, lower in ((folded, True), (plain, False)) if words]
        for batch in batches:
            places, found = [], []
            for place, text in enumerate(batch.column("text").to_pylist()):
                hits = 0
                for machine, lower in machines if text else ():
                    for _, mask in machine.iter(text.lower() if lower else text):
                        hits |= mask
                        if hits == everything:
                            break
                if hits:
                    places.append(place)
                    found.append([n for n in names if hits & bit[n]])
            kept = batch.select(list(keys)).take(pa.array(places, pa.int64()))
            yield kept.append_column("signals", pa.array(found, pa.list_(pa.string())))

    source = messages.select(*keys, "text")
    schema = source.select(*keys, F.array().cast("array<string>").alias("signals")).schema
    return source.mapInArrow(run, schema)
