"""BPE encoding and decoding on a public ``tokenizers`` vocabulary file.

Method: contiguous rank array.  A word is a list of parts and beside it the
list of the merge ranks of neighbouring parts; the smallest rank is found by a
scan of the (short) list, its right boundary is deleted and the two ranks next
to it are refreshed.  Words above ``SHORT`` parts use a heap over linked parts
with the same order of merges, so one endless word stays n log n.

Words are memoised per Python worker in a bounded table, so a word costs its
merges once per worker and not once per occurrence.

Rows: null text encodes like the empty one (no ids, decoded text empty);
repeated rows and ties are independent of each other; an empty table gives an
empty result; other columns pass through, columns named like an output are
replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts up to which the rank array is scanned.
SHORT = 48
#: Memoised words per Python worker.
MEMO = 150_000

SPECIAL = regex.compile(r"<\|(?:start|end)oftext\|>")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
#: The same split in the classes of ``re``, which is faster; characters that it
#: classes otherwise (``Codec.odd``) send their text to the exact pattern.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[\x1c-\x1f]|(?:_|[^\s\w])+")
INF = 1 << 30

# Lower-case pairs that the tokenizer's Unicode tables have and
# Python's do not, as (first upper, last upper, step, first lower).
NEWER_LOWER = (
    (0x1C89, 0x1C89, 1, 0x1C8A),
    (0xA7CB, 0xA7CB, 1, 0x0264),
    (0xA7CC, 0xA7DA, 2, 0xA7CD),
    (0xA7DC, 0xA7DC, 1, 0x019B),
    (0x10D50, 0x10D65, 1, 0x10D70),
    (0x16EA0, 0x16EB8, 1, 0x16EBB),
)

# Letters and digits of the tokenizer's Unicode tables (16.0)
# that Python's tables (15.1) do not have, as first and last character.
NEWER = {
    "L": ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
          (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
          (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
          (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
          (0x1E5F0, 0x1E5F0)),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
          (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}


def _newer_lower() -> dict[int, int]:
    return {c: low + (c - a) for a, b, step, low in NEWER_LOWER for c in range(a, b + 1, step)
            if chr(c).lower() == chr(c)}


def _byte_chars() -> list[str]:
    """Printable stand-ins of the 256 bytes: Latin-1 printables stand for
    themselves, the others follow from U+0100 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Exotic(Exception):
    """A piece holds a character on which the regex tables disagree."""


class Codec(dict):
    """word -> its ids as int32 bytes, filled on demand; also ids -> token strings."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = t
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        chars = _byte_chars()
        self.inner = [vocab.get(c, -1) for c in chars]
        self.last = [vocab.get(c + self.end, -1) for c in chars]
        self.lower = _newer_lower()
        self.exact = None
        self.odd = self._odd()

    def _odd(self) -> frozenset[str]:
        """Characters that ``re`` and the tokenizer's tables class differently."""
        odd = set(map(chr, self.lower))
        newer = {k: {chr(c) for a, b in NEWER[k] for c in range(a, b + 1)} for k in "LN"}
        for at in range(0, 0x110000, 0x800):  # in pieces: a worker keeps what it once allocated
            if 0xD800 <= at < 0xE000:
                continue
            every = "".join(map(chr, range(at, at + 0x800)))
            odd |= set(regex.findall(r"\s", every)) ^ set(re.findall(r"\s", every))
            for k, pattern in (("L", r"[^\W\d_]"), ("N", r"\d")):
                own = {c for c in every if unicodedata.category(c)[0] == k or c in newer[k]}
                odd |= own ^ set(re.findall(pattern, every))
        return frozenset(odd)

    @staticmethod
    def _members(kind: str) -> list[int]:
        newer = {c for a, b in NEWER[kind] for c in range(a, b + 1)}
        return [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind or c in newer]

    def _exact(self):
        if self.exact is None:
            sets = {}
            for k in "LN":
                cs = self._members(k)
                runs, start = [], cs[0]
                for a, b in zip(cs, cs[1:] + [0x200000]):
                    if b != a + 1:
                        runs.append(f"\\U{start:08x}-\\U{a:08x}")
                        start = b
                sets[k] = "".join(runs)
            self.exact = regex.compile(SPLIT.format(**sets))
        return self.exact

    def _scan(self, ids: list[int]) -> list[int]:
        rank, made = self.rank, self.made
        r = [rank.get(a << 32 | b, INF) for a, b in zip(ids, ids[1:])]
        while r:
            least = min(r)
            if least == INF:
                break
            i = r.index(least)
            ids[i] = made[least]
            del ids[i + 1], r[i]
            if i < len(r):
                r[i] = rank.get(ids[i] << 32 | ids[i + 1], INF)
            if i:
                r[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], INF)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        rank, made, n = self.rank, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1], INF)) < INF]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank.get(ids[i] << 32 | ids[j], INF) != r:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank.get(ids[i] << 32 | ids[k], INF)) < INF:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank.get(ids[h] << 32 | ids[i], INF)) < INF:
                heapq.heappush(heap, (q, h))
        return [x for x in ids if x >= 0]

    def word(self, w: str) -> bytes:
        raw = w.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if min(ids) < 0:
            ids = [i for i in ids if i >= 0]
        return array("i", self._scan(ids) if len(ids) <= SHORT else self._heap(ids)).tobytes()

    def __missing__(self, w: str) -> bytes:
        if not self.odd.isdisjoint(w):
            raise Exotic
        ids = self.word(w)
        if len(w) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[w] = ids
        return ids

    def _segment(self, text: str) -> bytes:
        t = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        try:
            return b"".join(map(self.__getitem__, FAST.findall(t.lower())))
        except Exotic:
            return b"".join(map(self.word, self._exact().findall(t.translate(self.lower).lower())))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as native int32."""
        if not text:
            return b""
        if "<|" not in text:
            return self._segment(text)
        out, at = [], 0
        for m in SPECIAL.finditer(text):
            out += [self._segment(text[at:m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._segment(text[at:])])

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space (the file names no decoder);
        null ids and ids outside the vocabulary are left out."""
        t = self.tokens
        try:
            return " ".join(map(t.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join([t[i] for i in ids if i is not None and 0 <= i < len(t)])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file; its memo lives across tasks."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _with_schema(df: DataFrame, name: str, kind: str):
    return df.drop(name).withColumn(name, F.lit(None).cast(kind)).schema


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out`` array<int>: the ids of the whole text.  ``path``: the
    vocabulary file, readable on every executor."""
    rest = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                col = _id_lists([c.encode_bytes(t) for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in rest), col], [*rest, out])

    return df.mapInArrow(run, _with_schema(df, out, "array<int>"))


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Both in one pass: add ``ids`` and the text decoded from them."""
    rest = [c for c in df.columns if c not in (ids, out)]
    schema = df.select(*rest, F.lit(None).cast("array<int>").alias(ids), F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                raw = [c.encode_bytes(t) for t in part.column(text).to_pylist()]
                texts = [c.decode(array("i", x)) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in rest), _id_lists(raw), pa.array(texts, pa.string())], [*rest, ids, out])

    return df.mapInArrow(run, schema)


def _id_lists(raw: list[bytes]) -> pa.Array:
    off = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in raw], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` string: the decoded text of the id column."""
    rest = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                col = part.column(ids)
                flat = col.flatten()
                flat = flat.to_numpy().tolist() if not flat.null_count else flat.to_pylist()
                size = pc.fill_null(pc.list_value_length(col), 0).to_pylist()
                cut = [0, *accumulate(size)]
                texts = pa.array([c.decode(flat[i:j]) for i, j in zip(cut, cut[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in rest), texts], [*rest, out])

    return df.mapInArrow(run, _with_schema(df, out, "string"))
