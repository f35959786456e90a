"""Periodic runs of words, by enumeration of maximal pairs.

A run is a longest stretch of words with smallest period ``q`` whose length is
at least ``shortest`` and ``exponent * q``.  If words ``s, s+1, ...`` make such a
run, the suffixes at ``s`` and ``s + q`` have exactly its length less ``q`` words
in common and different words to their left: they are a maximal pair.  So runs
are just the maximal pairs whose distance is at most the common length divided
by ``exponent - 1``, and nothing has to be extended.

A task sorts the suffixes of its texts by prefix doubling (only suffixes whose
start is still shared are sorted again) and reads the common lengths (LCP) of
neighbours off the doubling ranks.  Suffixes that share the least common length
of any run form classes; a class whose nearest two members are farther apart
than its deepest common length allows holds no run.  In the others the tree of
LCP intervals is walked bottom-up: a node has its suffixes in one sorted list
per left word, the smaller child goes into the larger, and each of its suffixes
is held against the lists of other left words, within the distance allowed.  A
period's multiples give the same stretch; the smallest is kept.

Texts stay in their task and no rows are exchanged; a task needs some 100 bytes
a word of its longest text, and 4 more for every doubling that still finds
repeats.

Words are ``[^\\x20\\x09-\\x0D]+`` as written (case counts), compared by 64-bit
hashes.  Rows: null, empty and wordless texts have no runs and collapse to the
empty text; repeated rows and equal keys are worked on row by row; an empty
table gives an empty result; other columns pass through, columns named like an
output (n_words, runs, collapsed) are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EXACT, mix, slices, span_hashes, utf8, word_spans

EXPONENT, SHORTEST = 4, 6
STEP = 2 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def least_common(exponent: int, shortest: int) -> int:
    """Words that the two suffixes of any run have in common at least."""
    return min(max(shortest - q, (exponent - 1) * q) for q in range(1, shortest + 1))


def _starts(new: np.ndarray) -> np.ndarray:
    """For each item the index of the last ``new`` one up to it."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _first_of(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return new


def suffix_order(h: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that share words with another of their text (all that share
    ``least``), in suffix order; words in common with the one before (0 for the
    first of another text or start); and each word's rank."""
    n = len(h)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][text]
    key = h ^ mix(text, 5)  # equal for equal words of one text
    act = np.argsort(key)
    new = _first_of(key[act])
    rank = np.empty(n, dtype=np.int64)
    rank[act] = _starts(new)
    levels = [(1, rank.astype(np.int32 if n < 2**31 else np.int64))]
    shared = ~(new & np.append(new[1:], True)) if n else new
    act, size = act[shared], 1
    chosen = act
    while len(act):
        if size <= least:
            chosen = act
        then = act + size
        second = np.where(then < last[act], rank[np.minimum(then, n - 1)] + 1, 0)
        key = rank[act] * (n + 1) + second
        order = np.argsort(key)
        key, act = key[order], act[order]
        old, new = rank[act], _first_of(key)
        rank[act] = old + _starts(new) - _starts(_first_of(old))
        levels.append((size * 2, rank.astype(levels[0][1].dtype)))
        act, size = act[~(new & np.append(new[1:], True))], size * 2
    chosen = chosen[np.argsort(rank[chosen])]
    common = np.zeros(len(chosen), dtype=np.int64)
    if len(chosen):
        i, j = chosen[:-1].copy(), chosen[1:].copy()
        i_end, j_end = last[i], last[j]
        for size, r in reversed(levels):
            same = (i < i_end) & (j < j_end)
            same &= r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)]
            i[same] += size
            j[same] += size
        common[1:] = i - chosen[:-1]
    return chosen, common, levels[0][1]


class _Walk:
    """One class of suffixes: its LCP-interval tree, bottom-up."""

    def __init__(self, left: dict[int, int], exponent: int, shortest: int):
        self.left, self.ratio, self.shortest = left, exponent - 1, shortest
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> period

    def pair(self, x: int, y: int, common: int) -> None:
        x, y = abs(x), abs(y)
        start, q = min(x, y), abs(x - y)
        if q + common >= self.shortest:
            at = (start, start + q + common)
            self.found[at] = min(q, self.found.get(at, q))

    def merge(self, a, b, common: int):
        """Nodes: ({left word: sorted suffixes}, all suffixes sorted)."""
        if len(a[1]) < len(b[1]):
            a, b = b, a
        lists, spots = a
        reach = common // self.ratio
        for own, xs in b[0].items():
            for x in xs:
                lo, hi = x - reach, x + reach
                if len(lists) > 4 and bisect_right(spots, hi) - bisect_left(spots, lo) < len(lists):
                    for k in range(bisect_left(spots, lo), bisect_right(spots, hi)):
                        if self.left[abs(spots[k])] != own:
                            self.pair(x, spots[k], common)
                    continue
                for other, ys in lists.items():
                    if other != own:
                        for k in range(bisect_left(ys, lo), bisect_right(ys, hi)):
                            self.pair(x, ys[k], common)
        for own, xs in b[0].items():
            mine = lists.setdefault(own, [])
            for x in xs:
                insort(mine, x)
                insort(spots, x)
        return a

    def walk(self, at: list[int], common: list[int]) -> None:
        # the side of the deepest intervals is merged first; mirrored where needed, so that lists grow at their end
        sign = 1 if (at[0] <= at[-1]) == (common[1] >= common[-1]) else -1
        open_: list[tuple[int, tuple]] = []  # intervals that wait for their next child
        node = ({self.left[at[0]]: [sign * at[0]]}, [sign * at[0]])
        for p, c in zip(at[1:], common[1:]):
            while open_ and open_[-1][0] > c:
                deep, before = open_.pop()
                node = self.merge(before, node, deep)
            if open_ and open_[-1][0] == c:
                node = self.merge(open_.pop()[1], node, c)
            open_.append((c, node))
            node = ({self.left[p]: [sign * p]}, [sign * p])
        while open_:
            deep, before = open_.pop()
            node = self.merge(before, node, deep)


def _word_before(i: int, rank: np.ndarray, first: np.ndarray) -> int:
    return -1 if i == 0 or first[np.searchsorted(first, i)] == i else int(rank[i - 1])


def runs(h: np.ndarray, first: np.ndarray, exponent: int = EXPONENT,
         shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``h``), length and period of all runs, by start, then period.
    Text d has the words first[d]:first[d + 1]."""
    least = least_common(exponent, shortest)
    at, common, rank = suffix_order(h, first, least)
    head = np.append(np.flatnonzero(common < least), len(at))  # classes: at[head[k]:head[k + 1]]
    lo, hi = head[:-1][np.diff(head) > 1], head[1:][np.diff(head) > 1]
    out: set[tuple[int, int, int]] = set()
    for a, b in _alive(at, common, lo, hi, exponent - 1):
        p = at[a:b].tolist()
        w = _Walk({i: _word_before(i, rank, first) for i in p}, exponent, shortest)
        w.walk(p, common[a:b].tolist())
        out.update((s, e - s, q) for (s, e), q in w.found.items())
    table = np.array(sorted(out, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _alive(at, common, lo, hi, ratio: int) -> list[tuple[int, int]]:
    """Classes whose nearest two members are close enough for their deepest
    common length."""
    if not len(lo):
        return []
    size = hi - lo
    begin = np.cumsum(size) - size
    inside = np.repeat(np.arange(len(lo)), size)
    here = np.arange(len(inside)) + (lo - begin)[inside]
    p = at[here][np.lexsort((at[here], inside))]
    gap = np.append(np.diff(p), 0)
    gap[begin + size - 1] = 2**62
    inner = common[here]
    inner[begin] = 0
    near = np.minimum.reduceat(gap, begin) <= np.maximum.reduceat(inner, begin) // ratio
    return list(zip(lo[near].tolist(), hi[near].tolist()))


def collapse(buf, starts, ends, first, kept) -> pa.Array:
    """The ``kept`` words of each text, joined by one space."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[kept]
    starts, size = starts[kept], (ends - starts)[kept]
    room = size + 1
    if len(owner):
        room[np.append(owner[1:] != owner[:-1], True)] -= 1  # no space after a text's last word
    to = np.cumsum(room)
    total = int(to[-1]) if len(to) else 0
    out = np.full(total, 32, dtype=np.uint8)
    inside = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    out[(to - room)[inside] + nth] = buf[starts[inside] + nth]
    off = np.concatenate([[0], to])[np.searchsorted(owner, np.arange(len(first)))]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def find_runs(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """Add n_words, runs (start, length, period: by start, then period) and
    collapsed: the text without the words that any run has after its first
    period, joined by one space."""
    new = {"n_words": "bigint", "runs": RUNS, "collapsed": "string"}
    rest = [c for c in docs.columns if c not in new]
    schema = docs.select(*rest, *(F.lit(None).cast(t).alias(c) for c, t in new.items())).schema
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text, STEP):
                buf, off = utf8(part.column(text))
                starts, ends, first = word_spans(buf, off)
                s, n, q = runs(span_hashes(buf, starts, ends, EXACT), first, exponent, shortest)
                change = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(change, s + q, 1)
                np.add.at(change, s + n, -1)
                kept = np.cumsum(change)[:-1] == 0
                begin = np.searchsorted(s, first)
                local = s - first[np.searchsorted(first, s, side="right") - 1]
                table = pa.StructArray.from_arrays([pa.array(local), pa.array(n), pa.array(q)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(np.diff(first)),
                     pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), table),
                     collapse(buf, starts, ends, first, kept)], [*rest, *new])

    return docs.select(*rest).mapInArrow(run, schema)
