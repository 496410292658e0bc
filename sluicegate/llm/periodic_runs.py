"""Periodic runs of words, found as maximal pairs of a suffix order.

A run with period q is a maximal pair: two equal stretches, q words apart, that differ in the
words to their left and to their right. So each text's suffixes are ordered, the intervals of
equal prefixes (the LCP-interval tree) are visited from the longest prefix up, and every
interval holds its occurrences in lists, one for each left word. Where two children of an
interval meet, occurrences of unlike classes are paired; a pair that shares l words at
distance q is the run of q + l words from the first one, provided that this is long enough.
Nothing is extended afterwards. The same run also shows at multiples of its period, of which
the smallest counts.

Occurrences that are near enough for a run lie in one evenly spaced row, of which only the
first can be in another class. So only neighbours in a list need a look, and the work for a
text of n words is about n log n, whatever its repeats.

Defined results: a NULL or empty text has no words and no runs, and its collapsed text is
empty; very long texts are taken whole, one at a time; equal rows have equal results; of runs that
start alike the one with the smaller period comes first; an empty frame gives an empty
frame. Only the named columns are read, so no name can clash. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import text_batches

MIN_LENGTH, MIN_EXPONENT = 6, 4
# Texts are worked on together up to so many words; a longer one is worked on alone.
GROUP_WORDS = 1 << 16
# Lists of classes that an interval searches one by one; beyond, it keeps one for all.
MAX_CLASSES = 16

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Occurrences:
    """Positions with a common prefix, in sorted lists by left word."""

    __slots__ = ("classes", "order", "size")

    def __init__(self, at: int, left: int):
        self.classes = {left: [at]}
        self.order: list[int] | None = None
        self.size = 1

    def near(self, at: int, left: int, lefts: list[int]) -> list[int]:
        """Neighbours of a position, of other classes than its own."""
        if self.order is not None:
            k = bisect(self.order, at)
            return [y for y in self.order[max(k - 1, 0) : k + 1] if lefts[y] != left]
        found = []
        for other, positions in self.classes.items():
            if other != left:
                k = bisect(positions, at)
                found += positions[max(k - 1, 0) : k + 1]
        return found

    def add(self, other: _Occurrences) -> None:
        for left, positions in other.classes.items():
            own = self.classes.get(left)
            if own is None:
                self.classes[left] = positions
            else:
                for at in positions:
                    insort(own, at)
        self.size += other.size
        if self.order is not None:
            for positions in other.classes.values():
                for at in positions:
                    insort(self.order, at)
        elif len(self.classes) > MAX_CLASSES:
            self.order = sorted(at for positions in self.classes.values() for at in positions)


def _refined(rank: np.ndarray, live: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after ordering the `live` positions of equal rank by `second`, and those that
    still share theirs. A rank is the first place of its group in the order."""
    order = live[np.argsort(rank[live].astype(np.int64) * (int(second.max(initial=0)) + 2) + second[live] + 1)]
    old, by = rank[order], second[order]
    places = np.arange(len(order))
    new_old = np.ones(len(order), dtype=bool)
    new_old[1:] = old[1:] != old[:-1]
    new = new_old.copy()
    new[1:] |= by[1:] != by[:-1]
    first_old = np.maximum.accumulate(np.where(new_old, places, 0))
    first = np.maximum.accumulate(np.where(new, places, 0))
    out = rank.copy()
    out[order] = old + (first - first_old)
    alone = new.copy()
    alone[:-1] &= new[1:]
    return out, order[~alone]


def _suffixes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, each text's together, and ranks by their first 1, 2, 4 ... words."""
    end = np.repeat(starts + sizes, sizes)
    here = np.arange(len(words))
    rank, live = _refined(np.repeat(starts, sizes), here, words)
    levels, width = [rank], 1
    while len(live):
        ahead = here + width
        inside = ahead < end
        second = np.where(inside, rank[np.where(inside, ahead, 0)], -1)
        rank, live = _refined(rank, live, second)
        levels.append(rank)
        width *= 2
    order = np.empty(len(words), dtype=np.int64)
    order[rank] = here
    return order, levels


def _shared(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes a and b have in common."""
    size = len(levels[0])
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < size) & (y < size)
        same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        common += same << k
    return common


def _pairs(order: list[int], common: list[int], lefts: list[int], least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """start, length, period of the maximal pairs whose distance is at most 1 / (exponent - 1)
    of what they share. `common[i]` is shared by the suffixes i and i + 1 of the order."""
    stack: list[tuple[int, _Occurrences]] = []
    for i, shares in enumerate(common):
        at = order[i]
        node = _Occurrences(at, lefts[at])
        while stack and stack[-1][0] >= shares:
            depth, held = stack[-1] if stack[-1][0] == shares else stack.pop()
            large, small = (held, node) if held.size >= node.size else (node, held)
            if len(large.classes) > 1 or large.classes.keys() != small.classes.keys():
                reach = depth // (exponent - 1)
                for left, positions in small.classes.items():
                    for x in positions:
                        for y in large.near(x, left, lefts):
                            if abs(x - y) <= reach:
                                yield min(x, y), depth + abs(x - y), abs(x - y)
            large.add(small)
            node = large
            if depth == shares:
                stack[-1] = (depth, node)
                break
        else:
            if shares >= least:
                stack.append((shares, node))


def runs_of(texts: list[np.ndarray], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """For each text, as word numbers, its runs (start, length, period) in order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    least = min(max((min_exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))
    words = np.concatenate(texts) if texts else np.empty(0, dtype=np.int64)
    if len(words) > 1:
        order, levels = _suffixes(words, starts, sizes)
        # Suffixes that share `least` words with a neighbour, in stretches.
        top = min(len(levels) - 1, max(least, 1).bit_length() - 1)
        near = np.flatnonzero(levels[top][order[1:]] == levels[top][order[:-1]])
        common = _shared(order[near], order[near + 1], levels)
        near, common = near[common >= least], common[common >= least]
        if len(near):
            last = np.flatnonzero(np.append(np.diff(near) > 1, True))
            # After the last pair of a stretch comes its last suffix, which shares nothing on.
            chosen = np.insert(near, last + 1, near[last] + 1)
            shares = np.insert(common, last + 1, 0)
            lefts = np.full(len(words), -1, dtype=np.int64)
            lefts[1:] = words[:-1]
            lefts[starts[sizes > 0]] = -1
            owner = np.repeat(np.arange(len(texts)), sizes)
            for start, length, period in _pairs(order[chosen].tolist(), shares.tolist(), lefts.tolist(), least, min_exponent):
                if length >= min_length:
                    text = owner[start]
                    place = (int(start - starts[text]), length)
                    found[text][place] = min(period, found[text].get(place, period))
    return [sorted((s, n, q) for (s, n), q in f.items()) if f else [] for f in found]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([w for w, dropped in zip(words, np.cumsum(edges[:-1]).tolist()) if not dropped])


def find_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period) and `collapsed`: the words
    without repeats, with one space between.

    Words are what ASCII white space parts. A run has `min_length` words and `min_exponent`
    times its period, at least 3, or more.
    """
    if min_exponent < 3 or min_length < 2:
        raise ValueError("a run has its period at least three times")
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t.as_py() or b"").split() for t in batch.column(1)]
            runs: list[list[tuple[int, int, int]]] = []
            begin = 0
            while begin < len(rows):
                numbers: dict[bytes, int] = {}
                group: list[np.ndarray] = []
                held = 0
                while begin < len(rows) and (not group or held + len(rows[begin]) <= GROUP_WORDS):
                    words = rows[begin]
                    group.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64))
                    held += len(words)
                    begin += 1
                runs += runs_of(group, min_length, min_exponent)
            columns = [
                batch.column(0),
                pa.array([len(words) for words in rows], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], _RUNS),
                pa.array([_collapsed(words, found) for words, found in zip(rows, runs)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    schema = f"key {kind}, n_words bigint, runs array<{RUN}>, collapsed string"
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)
