"""Classifiers of the ask/answer exchange, built from rule tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.rules import Rule, any_match, default_rules, of_kind
from colloquia.functions.text import bind, clean_extracted, contains_any, trim_space


def _first_rule(rules: list[Column]) -> Column:
    """First non-null verdict of a rule list."""
    return F.get(F.array_compact(F.array(*rules)), F.lit(0))


def classify_ask(text: str | Column, has_quote: Column, rules: Sequence[Rule] | None = None) -> Column:
    """(intent, rule) of a request message, null for anything else. First rule wins."""
    rules = default_rules("ask") if rules is None else rules

    def verdict(intent: Column, rule: Column) -> Column:
        return F.struct(intent.alias("intent"), rule.alias("rule"))

    def judge(message: Column) -> Column:
        size = F.length(message)
        letter = F.lower(F.regexp_extract(message, fv.SHORT_ASK, 1))
        intents = F.create_map(*[F.lit(x) for r in of_kind(rules, "short") for x in (r.pattern, r.value)]).cast("map<string,string>")
        comment = any_match(message, [r.pattern for r in of_kind(rules, "comment")])
        exact = [F.when((size <= fv.EXACT_ASK_CHARS) & message.rlike(r.pattern), verdict(F.lit(r.value), F.lit("exact"))) for r in of_kind(rules, "exact")]
        open_ask = has_quote & (size <= fv.CONTEXTUAL_ASK_CHARS) & ~comment
        contextual = [F.when(open_ask & message.rlike(r.pattern), verdict(F.lit(r.value), F.lit("contextual"))) for r in of_kind(rules, "contextual")]
        short = F.when(~message.rlike(fv.ASK_MEANING), verdict(F.try_element_at(intents, letter), F.concat(F.lit("kk:"), letter)))
        listed = [*exact, *contextual]
        return F.when(letter != "", short).otherwise(_first_rule(listed)) if listed else F.when(letter != "", short)

    return bind(clean_extracted(text), judge)


def looks_like_prompt(text: str | Column, rules: Sequence[Rule] | None = None) -> Column:
    """Whether a message is a pasted generation prompt rather than chat.

    If there are ``hint`` rules, a text without any of them is not looked at further."""
    rules = default_rules("answer") if rules is None else rules
    markers, vocabulary, hints = ([r.pattern for r in of_kind(rules, k)] for k in ("marker", "vocabulary", "hint"))

    def judge(message: Column) -> Column:
        size = F.length(message)
        han = F.length(F.regexp_replace(message, r"[^\p{IsHan}]", ""))
        prose = message.rlike(fv.PROSE_MARK) & (han / size > fv.PROSE_HAN_SHARE)
        hits = sum((message.rlike(p).cast("int") for p in vocabulary), F.lit(0))
        segments = F.filter(F.transform(F.split(message, "[,，\n]"), lambda p: trim_space(p)), lambda p: p != "")
        short = F.size(F.filter(segments, lambda p: F.length(p) <= fv.MAX_SEGMENT_CHARS))
        shaped = (hits >= fv.MIN_VOCABULARY_HITS) & (short >= fv.MIN_PROMPT_SEGMENTS)
        return (size >= fv.MIN_PROMPT_CHARS) & (any_match(message, markers) | (shaped & ~prose))

    raw = F.col(text) if isinstance(text, str) else text
    hinted = bind(F.lower(raw), lambda low: contains_any(low, hints)) if hints else raw.isNotNull()
    return F.when(hinted, bind(trim_space(raw), judge)).otherwise(False)
