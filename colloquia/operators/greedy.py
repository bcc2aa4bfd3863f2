"""The sequential part of greedy topic mining, over a bounded extract of each group.

Token sets are bit masks in long columns ``w0``, ``w1``, ... of ``WORD`` bits each. A group's
extract holds its first seeds in seed order, its token counts, the members found so far and the
best-scored rows of the seeds planned before. Topics are taken as far as those lists reach; the
rest of the topics is then guessed from the seeds alone, and the guess is the next plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

WORD = 62
NEAR, SAME_DAY = 3 * 3600, 12 * 3600
STATE = "group_id string, kind string, number long, row_id string, sent_at long, input_order long, score long, need long"


def word_names(tokens: int) -> list[str]:
    return [f"w{i}" for i in range((tokens + WORD - 1) // WORD)]


def state_schema(tokens: int) -> str:
    return ", ".join([STATE, *[f"{w} long" for w in word_names(tokens)]])


def bits(masks: np.ndarray) -> np.ndarray:
    """One row of 0/1 per mask, one column per token position."""
    shifts = np.arange(WORD, dtype=np.int64)
    return ((masks[:, :, None] >> shifts) & 1).reshape(len(masks), masks.shape[1] * WORD)


def scores(masks: np.ndarray, times: np.ndarray, mask: np.ndarray, time: float) -> np.ndarray:
    """Score (tenths of a point) of every row against one seed; 0 without a shared token."""
    overlap = np.bitwise_count(masks & mask).sum(axis=1).astype(np.int64)
    apart = np.abs(times - time)
    return np.where(overlap > 0, overlap * 30 + np.where(apart <= NEAR, 10, np.where(apart <= SAME_DAY, 4, 0)), 0)


class _Progress:
    """Used rows, free token counts and the last seed of one group."""

    def __init__(self, used: set, free: np.ndarray, last: int, topics: int):
        self.used, self.free, self.last, self.topics = used, free, last, topics

    def copy(self) -> _Progress:
        return _Progress(set(self.used), self.free.copy(), self.last, self.topics)

    def next_seed(self, numbers: np.ndarray, ids: np.ndarray, held: np.ndarray) -> int | None:
        """Index of the next unused seed that shares a token with another unused row."""
        able = (held & (self.free >= 2)).any(axis=1) & (numbers > self.last)
        return next((i for i in np.flatnonzero(able) if ids[i] not in self.used), None)

    def take(self, number: int, ids: np.ndarray, held: np.ndarray) -> None:
        self.used.update(ids)
        self.free -= held.sum(axis=0)
        self.last, self.topics = number, self.topics + 1


def topic_step(tokens: int, rounds: int, size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """State of a group -> its newly found members, last seed and plan (rows of ``state_schema``)."""
    words = word_names(tokens)
    columns = ["group_id", "kind", "number", "row_id", "sent_at", "input_order", "score", "need", *words]

    def step(state: pd.DataFrame) -> pd.DataFrame:
        part = dict(iter(state.groupby("kind")))
        empty = state.iloc[:0]
        seeds = part.get("seed", empty).sort_values("number")
        numbers, ids, times = seeds["number"].to_numpy(), seeds["row_id"].to_numpy(), seeds["sent_at"].to_numpy(dtype=float)
        masks = seeds[words].to_numpy(np.int64)
        held = bits(masks).astype(bool)
        free = np.zeros(len(words) * WORD, np.int64)
        counts = part.get("count", empty)
        free[counts["number"].to_numpy(np.int64)] = counts["score"].to_numpy(np.int64)
        members = part.get("member", empty)
        free -= bits(members[words].to_numpy(np.int64)).sum(axis=0)
        last = part.get("last", empty)["number"]
        at = _Progress(set(members["row_id"]), free, int(last.max()) if len(last) else 0, int(members["number"].max()) if len(members) else 0)
        lists = {int(n): rows.sort_values("need") for n, rows in part.get("listed", empty).groupby("number")}
        out = []
        seed = at.next_seed(numbers, ids, held) if at.topics < rounds else None
        while seed is not None and int(numbers[seed]) in lists:
            listed = lists[int(numbers[seed])]
            best = listed[~listed["row_id"].isin(at.used)].iloc[:size]
            at.take(int(numbers[seed]), best["row_id"].to_numpy(), bits(best[words].to_numpy(np.int64)))
            out.append(best.assign(kind="member", number=at.topics))
            seed = at.next_seed(numbers, ids, held) if at.topics < rounds else None
        out.append(state.iloc[:1].assign(kind="last", number=at.last))
        guess = at.copy()
        while seed is not None:
            points = scores(masks, times, masks[seed], times[seed])
            need = size * (guess.topics + 1)
            shared = int((points > 0).sum())
            # the seeds alone show how low a score can still be among the best ``need``
            bound = int(np.partition(points, len(points) - need)[len(points) - need]) if shared >= need else 1
            out.append(seeds.iloc[[seed]].assign(kind="plan", score=bound, need=need))
            open_rows = np.array([i not in guess.used for i in ids]) & (points > 0)
            order = np.lexsort((times, -points))
            best = order[open_rows[order]][:size]
            guess.take(int(numbers[seed]), ids[best], bits(masks[best]))
            seed = guess.next_seed(numbers, ids, held) if guess.topics < rounds else None
        return pd.concat(out)[columns]

    return step
