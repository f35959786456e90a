"""Benchmark decontamination with spaced seeds.

Fixed masks over windows of ``SPAN`` words ignore some positions, so a leaked
passage is found although words of it were substituted.  The masks leave out
nothing that counts as overlap: a stretch of ``MIN_WORDS`` words or more falls
into pieces of 12 to 23, one of them with ``SHARE`` equal, which holds 12 words
with 2 substituted, 15 with 3 or 20 with 4, and each such pattern leaves a mask
intact at some place (all are gone through in the tests).  The masked windows of
the benchmark are hashed into a table; every window of every document is
hashed under the same masks and looked up; around each hit the document and
the item are laid side by side and a stretch counts as overlap when at least
``MIN_WORDS`` aligned words lie between equal ones and ``SHARE`` of them are
equal.  Items of fewer than ``SPAN`` words must occur whole (all words equal).

The table is broadcast in blocks of items of a bounded number of windows, one
pass over the documents for each block.  All blocks are in the driver's memory
(a benchmark is small beside a corpus); nothing of the documents is shuffled.

A document and an item have one hit: their longest overlap (ties: the first
alignment).  Where both repeat themselves after the same number of words, only
the first of the equal pairs of windows is looked at, since the others lie on
the same diagonals; very long repetitive texts stay cheap and lose no alignment.

Rows: null or wordless texts and items overlap with nothing; repeated rows and
items are judged each on its own; an empty benchmark marks nothing, an empty
table gives an empty result; other columns pass through, columns named like
an output (hits) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, saved, slices, span_hashes, utf8, word_spans

#: Masks of weight 7 on 12 words (1: the word counts), found by search.  Between
#: them every 2 substitutions of 12 words, 3 of 15 and 4 of 20 leave one intact.
MASKS = ("110110000111", "111100001101", "100101011011", "010001110111", "111101100010",
         "001010101111", "111010111000", "100111110100", "010110111001", "010011011110")
SPAN = 12
MIN_WORDS = 12
SHARE = 0.8
#: Windows of one broadcast block: about 300 MB with the words of its items.
BLOCK_WINDOWS = 2_000_000
#: Aligned words that are compared at once.
COMPARED = 1 << 20
HITS = "array<struct<item_id: bigint, start: int, words: int, equal: int>>"
BITS = 22


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of ``SPAN`` consecutive words under a mask."""
    n = max(len(h) - SPAN + 1, 0)
    acc = np.zeros(n, dtype=U64)
    for i, c in enumerate(mask):
        if c == "1":
            acc = (acc + h[i:i + n]) * U64(0x9FB21C651E98DF25)
    return mix(acc, int(mask, 2))


class Index:
    """Hash tables of a block of items: one for each mask, one for short items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.size = np.array([len(h) for _, h in items], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.words = np.concatenate([h for _, h in items]) if items else np.zeros(0, U64)
        long = np.flatnonzero(self.size >= SPAN)
        per = np.maximum(self.size - SPAN + 1, 0)
        owner = np.repeat(np.arange(len(items)), per)
        where = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        self.tables = []
        for m in MASKS:
            w = np.concatenate([masked(items[i][1], m) for i in long]) if len(long) else np.zeros(0, U64)
            self.tables.append(self._sorted(w, owner, where))
        short = np.flatnonzero((self.size > 0) & (self.size < SPAN))
        self.short = {}
        for n in np.unique(self.size[short]).tolist():
            own = short[self.size[short] == n]
            w = np.array([self._whole(items[i][1])[0] for i in own], dtype=U64)
            self.short[n] = self._sorted(w, own, np.zeros(len(own), np.int64))

    @staticmethod
    def _whole(h: np.ndarray, n: int | None = None) -> np.ndarray:
        n = n or len(h)
        acc = np.zeros(len(h) - n + 1, dtype=U64)
        for i in range(n):
            acc = (acc + h[i:i + len(acc)]) * U64(0x9FB21C651E98DF25)
        return mix(acc, n)

    @staticmethod
    def _sorted(w, owner, where):
        order = np.argsort(w, kind="stable")
        seen = np.zeros(1 << BITS, dtype=bool)
        seen[(w & U64((1 << BITS) - 1)).astype(np.int64)] = True
        back = steps(w, np.arange(len(w)), where)
        rows = {0: (w[order], order.astype(np.int32))}
        for d in np.unique(back[back > 0]).tolist():  # without the rows that repeat after d words
            some = order[back[order] != d]
            rows[d] = (w[some], some.astype(np.int32))
        return rows, owner, where, seen

    @staticmethod
    def _matches(h, first, table):
        """(window of the text, row of the table) for equal hashes.  Where both
        texts repeat themselves after the same number of words, only the first
        of equal pairs: the others lie on the same diagonal."""
        rows, *_, seen = table
        maybe = np.flatnonzero(seen[(h & U64((1 << BITS) - 1)).astype(np.int64)])
        back = steps(h, maybe, maybe - first[np.searchsorted(first, maybe, side="right") - 1])
        out = []
        for d in np.unique(back).tolist():
            key, order = rows.get(d, rows[0])
            mine = maybe[back == d]
            at, to = (np.searchsorted(key, h[mine], side=s) for s in ("left", "right"))
            n = to - at
            k = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(mine, n), order[k]))
        return [np.concatenate(x) for x in zip(*out)] if out else (maybe, maybe)

    def _equal(self, h, first, text, item, line):
        """Equal words of each alignment."""
        lo = np.maximum(line, first[text])
        n = np.minimum(line + self.size[item], first[text + 1]) - lo
        b = self.begin[item] + lo - line
        upto = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(len(n), dtype=np.int64)
        at = 0
        while at < len(n):
            to = max(int(np.searchsorted(upto, upto[at] + COMPARED, side="right")) - 1, at + 1)
            step = np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], n[at:to])
            same = h[np.repeat(lo[at:to], n[at:to]) + step] == self.words[np.repeat(b[at:to], n[at:to]) + step]
            out[at:to] = np.add.reduceat(same, upto[at:to] - upto[at], dtype=np.int64)
            at = to
        return out

    def find(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, start word, words, equal words) of the longest
        overlap of each text first[d]:first[d + 1] of the word hashes ``h`` with
        each item."""
        found = []

        def align(w, rows, table, span):
            item, off = table[1][rows], table[2][rows]
            text = np.searchsorted(first, w, side="right") - 1
            inside = w + span <= first[text + 1]
            found.append(_distinct(np.stack([text, item, w - off], axis=1)[inside]))

        for m, table in zip(MASKS, self.tables):
            if len(table[1]) and len(h) >= SPAN:
                align(*self._matches(masked(h, m), first, table), table, SPAN)
        for n, table in self.short.items():
            if len(h) >= n:
                align(*self._matches(self._whole(h, n), first, table), table, n)
        if not found:
            return []
        lines = _distinct(np.concatenate(found))  # one alignment for each text, item and diagonal
        equal = self._equal(h, first, *lines.T)
        enough = equal >= np.minimum(np.ceil(SHARE * MIN_WORDS), self.size[lines[:, 1]])
        lines, equal = lines[enough], equal[enough]
        order = np.lexsort((lines[:, 2], -equal, lines[:, 1], lines[:, 0]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}  # (words, start, equal)
        for d, i, line, most in np.column_stack([lines, equal])[order].tolist():
            longest = best.get((d, i), (0, 0, 0))[0]
            lo, hi = max(line, int(first[d])), min(line + int(self.size[i]), int(first[d + 1]))
            if min(hi - lo, int(most / SHARE + 1e-9)) <= longest:
                continue  # no stretch of it can be longer
            b = int(self.begin[i]) + lo - line
            start, words, same = longest_overlap(h[lo:hi] == self.words[b:b + hi - lo])
            whole = self.size[i] >= SPAN or same == self.size[i]
            if words > longest and words >= min(MIN_WORDS, int(self.size[i])) and whole:
                best[d, i] = words, lo + start - int(first[d]), same
        return [(d, int(self.ids[i]), start, words, same) for (d, i), (words, start, same) in sorted(best.items())]


def steps(h: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For the windows ``at`` how many words before, at most ``SPAN``, the same
    hash stands in the same text (0: none); ``inside``: place in the text."""
    out = np.zeros(len(at), dtype=np.int64)
    for d in range(SPAN, 0, -1):
        some = np.flatnonzero(inside >= d)
        out[some[h[at[some]] == h[at[some] - d]]] = d
    return out


def _distinct(lines: np.ndarray) -> np.ndarray:
    lines = lines[np.lexsort(lines.T[::-1])]
    new = np.ones(len(lines), dtype=bool)
    new[1:] = (lines[1:] != lines[:-1]).any(axis=1)
    return lines[new]


def longest_overlap(same: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal) of the longest stretch that begins and ends with
    equal words and has at least ``SHARE`` of them equal."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # gain(i, j) = equal - SHARE * length >= 0 for the stretch of the i-th to the j-th equal word
    k = np.arange(len(at))
    left = k - SHARE * at
    right = (k + 1) - SHARE * (at + 1)
    lowest = np.minimum.accumulate(left)
    i = np.searchsorted(-lowest, -(right + 1e-9), side="left")  # first i whose running least is <= right
    i = np.minimum(i, k)
    j = int(np.argmax(at - at[i]))
    return int(at[i[j]]), int(at[j] - at[i[j]] + 1), int(j - i[j] + 1)


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """item, its word hashes, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text):
                buf, off = utf8(part.column(text))
                starts, ends, first = word_spans(buf, off)
                h = span_hashes(buf, starts, ends).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h)),
                     pa.array(np.diff(first).astype(np.int32))], ["item_id", "words", "n"])

    return saved(benchmark.select(key, text).mapInArrow(run, "item_id long, words array<long>, n int"), "bench-items")


def blocks(items: DataFrame, most: int) -> list[list[tuple[int, np.ndarray]]]:
    """The items in blocks of at most ``most`` windows (one item at least)."""
    out, size = [[]], 0
    for r in items.where("n > 0").toLocalIterator():
        if out[-1] and size + r["n"] > most:
            out, size = [*out, []], 0
        out[-1].append((-(2**63) if r["item_id"] is None else r["item_id"], np.array(r["words"], np.int64).view(U64)))
        size += r["n"]
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Add ``hits``: item, first word, length in words and equal words of the
    document's longest overlap with each benchmark item (empty: clean)."""
    rest = [c for c in docs.columns if c != "hits"]
    frame = docs.select(*rest).withColumn("hits", F.lit(None).cast(HITS))
    fields = ("item_id", "start", "words", "equal")
    kinds = pa.struct([("item_id", pa.int64()), *((c, pa.int32()) for c in fields[1:])])
    todo = blocks(_items(benchmark, item, item_text), block_windows)
    for block in todo:
        index = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            table = Index(index.value)
            for b in batches:
                for part in slices(b, text):
                    buf, off = utf8(part.column(text))
                    starts, ends, first = word_spans(buf, off)
                    found = [list(x or ()) for x in part.column("hits").to_pylist()]
                    for d, *hit in table.find(span_hashes(buf, starts, ends), first):
                        found[d].append(dict(zip(fields, hit)))
                    hits = pa.array(found, pa.list_(kinds))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), hits], [*rest, "hits"])

        frame = frame.mapInArrow(run, frame.schema)
    return frame


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **named) -> DataFrame:
    """The documents that overlap with no benchmark item, columns as given."""
    return find_overlaps(docs, benchmark, text, **named).where(F.size("hits") == 0).select(*docs.columns)
