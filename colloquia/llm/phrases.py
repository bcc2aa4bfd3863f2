"""Phrases of prefix-free parsing over bytes, in NumPy.

The trigger of a span (``SPAN`` bytes) is the ``GRAM``-byte string inside it whose rolling hash
is least (the first one on ties). It depends on the span's bytes alone, so equal spans have
equal triggers at equal places wherever they stand. Consecutive spans with one trigger
position form a phrase; phrases overlap by ``SPAN - 1`` bytes, and each span lies in exactly
one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SPAN, GRAM = 50, 16
PIECE = 1 << 20  # bytes hashed at once
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 24) - 1)


class Phrases(NamedTuple):
    """Per phrase: byte where it starts, number of its spans, trigger's offset in it, trigger hash, phrase hash."""

    start: np.ndarray
    spans: np.ndarray
    offset: np.ndarray
    trigger: np.ndarray
    mark: np.ndarray


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A + b
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def _phrases(data: np.ndarray, ends: np.ndarray) -> Phrases:
    """Phrases of one piece; no span crosses one of ``ends``."""
    h = data.astype(np.uint64)
    for step in (1, 2, 4, 8):  # hash of 2, 4, 8, 16 bytes
        h = mix(h[:-step], h[step:])
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width = SPAN - GRAM + 1
    least, reach = key, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & _PLACE).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in ends[ends < len(data)]:
        inside[max(0, end - SPAN + 1) : end] = False
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[1:] |= ~inside[:-1]
    new &= inside
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(at))
    if len(start):
        upto = np.cumsum(inside)
        stop = start + upto[stop - 1] - upto[start] + 1  # spans inside the phrase
    last = stop - 1
    half = lambda i: mix(h[i], h[i + 16])  # noqa: E731  32 bytes
    span = lambda i: mix(half(i), half(i + SPAN - 32))
    trigger = h[at[start]]
    return Phrases(start, last - start + 1, at[start] - start, trigger, mix(mix(span(start), span(last)), (last - start).astype(np.uint64)))


def parse(data: np.ndarray, ends: np.ndarray) -> Iterator[Phrases]:
    """Phrases of concatenated texts (``ends``: where each text ends), piece by piece.

    A phrase that meets the border of a piece is cut there: its parts are phrases with the
    same trigger, so nothing is lost.
    """
    at = 0
    while at + SPAN <= len(data):
        stop = min(len(data), at + PIECE)
        found = _phrases(data[at:stop], ends[(ends > at) & (ends <= stop)] - at)
        yield found._replace(start=found.start + at)
        at = stop - SPAN + 1
