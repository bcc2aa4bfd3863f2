"""Secret rules found through a trigram inverted index.

From the syntax tree of each rule's regular expression a Boolean query over byte trigrams is
derived that every matching text must satisfy. Each batch of texts is one index segment:
posting lists of the trigrams that any rule asks for, sorted by text. Queries intersect and
unite the postings, and only their candidates are verified by the expression itself. Rules
without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquia.llm.common import pick

SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
#: Alternatives that are spelled out before a part of an expression counts as unknown.
SPELLED = 64
TRUE = ("and", frozenset())


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of ``group`` that a match needs."""
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII


# fixed values: the base rules
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
# fixed values: the published forms of well-known credentials
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{16,}"),
    Rule("url_login", r"://[^\s/:@]+:[^\s/@]{3,}@"),
)
RULES = BASE + ADDED


def _lower(data: bytes) -> bytes:
    """ASCII letters only, as the index folds them."""
    return bytes(c + 32 if 65 <= c <= 90 else c for c in data)


def _all(*queries):
    """Conjunction. A query is a trigram, or ("and" | "or", set of queries); TRUE is the empty conjunction."""
    parts = set()
    for q in queries:
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _any(*queries):
    """Disjunction; alternatives that another one implies are left out (a or (a and b) is a)."""
    parts = {_all(q) for q in queries}
    if not parts or TRUE in parts:
        return TRUE
    wanted = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in parts}
    parts = {q for q in parts if not any(wanted[o] < wanted[q] for o in parts)}
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _spelled(strings: set[bytes]):
    """What a text must hold if it holds one of ``strings``."""
    return _any(*[_all(*[s[i:i + 3] for i in range(len(s) - 2)]) for s in strings])


def _letters(code: int, flags: int) -> set[bytes] | None:
    """Index bytes of one character; None where case folding may leave ASCII (the sharp cases of s, k and i)."""
    if flags & re.IGNORECASE and not flags & re.ASCII and (code > 127 or chr(code).lower() in "ski"):
        return None
    if flags & re.IGNORECASE and code > 127:
        return None
    return {_lower(chr(code).encode("utf-8", "surrogatepass"))}


def _derive(tree, flags: int) -> tuple[set[bytes] | None, object]:
    """(every string the part can match, or None if they are too many; the query implied by the part)."""
    open_, query = {b""}, TRUE  # strings of the run of known parts that is still growing
    known = True  # nothing but that run so far

    def stop():
        nonlocal open_, query, known
        query, open_, known = _all(query, _spelled(open_)), {b""}, False

    for name, value in tree:
        strings, implied = None, TRUE
        if name is op.LITERAL:
            strings = _letters(value, flags)
        elif name is op.IN and value[0][0] is not op.NEGATE:
            codes = set()
            for kind, x in value:
                codes |= {x} if kind is op.LITERAL else set(range(x[0], x[1] + 1)) if kind is op.RANGE and x[1] - x[0] < SPELLED else {None}
            if None not in codes and len(codes) <= SPELLED:
                letters = [_letters(c, flags) for c in codes]
                strings = None if None in letters else set().union(*letters)
        elif name is op.SUBPATTERN:
            _, add, remove, inner = value
            strings, implied = _derive(inner, (flags | add) & ~remove)
        elif name is op.ATOMIC_GROUP:
            strings, implied = _derive(value, flags)
        elif name is op.BRANCH:
            parts = [_derive(branch, flags) for branch in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*[s for s, _ in parts])
            implied = _any(*[_all(q, _spelled(s)) if s is not None else q for s, q in parts])
        elif name in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            part, need = _derive(inner, flags)
            if part is not None and high <= 4 and len(part) ** int(high) <= SPELLED:
                strings, grown = set(), {b""}
                for times in range(int(high) + 1):
                    strings |= grown if times >= low else set()
                    grown = {a + b for a in grown for b in part}
            elif low >= 1:
                implied = need
                if part is not None and len(part) ** min(low, 3) <= SPELLED:
                    grown = {b""}
                    for _ in range(min(low, 3)):
                        grown = {a + b for a in grown for b in part}
                    implied = _all(implied, _spelled(grown), _spelled({a + b for a in open_ for b in grown} if len(open_) * len(grown) <= SPELLED else open_))
        elif name in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # of no width: what they ask for is left to the verification
        if strings is None:
            stop()
            query = _all(query, implied)
        elif len(open_) * len(strings) > SPELLED:
            stop()
            open_ = strings
        else:
            open_ = {a + b for a in open_ for b in strings}
    if known and len(open_) <= SPELLED:
        return open_, TRUE
    stop()
    return None, query


def trigram_query(pattern: str, flags: int = re.ASCII):
    """The Boolean trigram query that every text with a match satisfies; TRUE if there is none."""
    tree = syntax.parse(pattern, flags)
    if tree.state.flags & (re.VERBOSE | re.LOCALE):
        return TRUE
    strings, query = _derive(tree, tree.state.flags)
    return query if strings is None else _spelled(strings)


def trigrams_of(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*[trigrams_of(q) for q in query[1]]) if query[1] else set()


def candidates(query, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Sorted numbers of the texts that satisfy the query: intersections and unions of posting lists."""
    if query == TRUE:
        return everything
    if isinstance(query, bytes):
        return postings.get(query, everything[:0])
    lists = [candidates(q, postings, everything) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(lists))
    lists.sort(key=len)
    found = lists[0]
    for other in lists[1:]:
        if not len(found):
            break
        found = np.intersect1d(found, other, assume_unique=True)
    return found


class Segment:
    """Inverted index of one batch of texts over the trigrams that a set of rules asks for."""

    FOLD = np.array(list(range(65)) + list(range(97, 123)) + list(range(91, 256)), np.uint8)

    def __init__(self, trigrams: set[bytes]):
        self.names = sorted(trigrams)
        self.number = np.zeros(1 << 24, np.uint16)  # trigram code -> its place in names, from 1
        for i, t in enumerate(self.names):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """Sorted text numbers by trigram, for texts laid end to end in ``data`` and cut at ``offsets``."""
        found = []
        for start in range(0, max(0, len(data) - 2), 1 << 20):  # pieces of bounded size, two bytes of overlap
            piece = self.FOLD[data[start:start + (1 << 20) + 2]].astype(np.int32)
            number = self.number[piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]]
            place = np.flatnonzero(number)
            text = np.searchsorted(offsets, place + start, "right") - 1
            whole = place + start + 3 <= offsets[text + 1]
            found.append(np.unique(number[place][whole].astype(np.int64) << 32 | text[whole]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        names, starts = np.unique(pairs >> 32, return_index=True)
        lists = np.split(pairs & 0xFFFFFFFF, starts[1:])
        return {self.names[n - 1]: texts for n, texts in zip(names.tolist(), lists)}


def matcher(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
    """Spans of the leftmost non-overlapping matches of a text; too short ones are dropped after matching.

    A single repeated character class, whose matches are whole runs, asks for its least length itself.
    """
    pattern, group, least = rule.pattern, rule.group, rule.least
    tree = syntax.parse(pattern, rule.flags)
    if least and not group and len(tree) == 1 and tree[0][0] is op.MAX_REPEAT and pattern.startswith("[") and pattern.endswith("]+"):
        pattern, least = f"{pattern[:-1]}{{{least},}}", 0
    found = re.compile(pattern, rule.flags).finditer
    if not least:
        return lambda text: [m.span() for m in found(text)]
    return lambda text: [m.span() for m in found(text) if m.end(group) - m.start(group) >= least]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row: spans in code points, end exclusive, by start, then in the order of the rules.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are
    ignored. An Arrow batch is an index segment, so memory is bounded by the batch.
    """
    queries = [trigram_query(r.pattern, r.flags) for r in rules]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, find = Segment(set().union(*map(trigrams_of, queries))), [matcher(r) for r in rules]
        for batch in batches:
            texts = batch.column(1)
            strings = texts.to_pylist()
            data, offsets = _laid_out(texts)
            postings, everything = segment.postings(data, offsets), np.flatnonzero(np.diff(offsets))
            spans: list[list[tuple[int, int, int]]] = [[] for _ in strings]
            for order, (query, matches) in enumerate(zip(queries, find)):
                for i in candidates(query, postings, everything).tolist():
                    spans[i] += [(start, order, end) for start, end in matches(strings[i])]
            out = [[{"kind": rules[order].kind, "start": start, "end": end} for start, order, end in sorted(s)] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(search, SPANS)


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the place where each begins (nulls are empty)."""
    whole = texts.fill_null("").cast(pa.large_string())
    _, ends, data = whole.buffers()
    offsets = np.frombuffer(ends, np.int64)[whole.offset:whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def listed(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: matches of each base kind, the hash of their spans, and all spans as ``kind:start:end``."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in BASE])
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
