"""Language identification with script ranges and Viterbi spans.

A model holds, for every learned language, the log probabilities of hashed
byte 1- to 4-grams of words and the scripts its letters come from.  To label a
text, the script ranges of each word's letters narrow the candidate languages
of that word; the candidates are scored by the word's n-grams; a Viterbi pass
over the words with a switching penalty finds the best sequence of labels, so
mixed text falls into spans of one language.  The prediction is the language
with most labelled letters, its score their share of all letters.

Training counts n-grams over all training rows (partial sums in every task,
then one aggregate of languages x buckets rows); the model's size depends on
the number of languages and ``BUCKETS`` alone and is what tasks are sent.

Rows: texts that are null or have no letter are ``und`` with score 0 and no
spans; training rows with null language or no letter teach nothing; with no
training row every prediction is ``und``; ties go to the language first in
order of name; repeated rows are independent; other columns pass through,
columns named like an output are replaced.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, slices, utf8, word_spans

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Log-probability cost of changing language between two words.
SWITCH = 8.0
#: Share of a language's letters that a script needs to make it a candidate.
SCRIPT_SHARE = 0.01
#: Pseudo-count of every bucket.
SMOOTH = 0.5
STEP = 2 << 20

# First code point of each range of scripts and its script
# (0: none in particular, such as digits, punctuation and combining marks).
SCRIPTS = ("common", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai_lao", "tibetan",
           "burmese", "georgian", "hangul", "ethiopic", "khmer", "mongolian", "kana", "han", "other")
RANGES = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00BA, 1),
    (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x02B0, 0), (0x0370, 2),
    (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 18), (0x0750, 6), (0x0780, 18), (0x0900, 7),
    (0x0E00, 8), (0x0F00, 9), (0x1000, 10), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x13A0, 18), (0x1780, 14),
    (0x1800, 15), (0x18B0, 18), (0x1C80, 3), (0x1C90, 11), (0x1CC0, 18), (0x1D00, 1), (0x1DC0, 0), (0x1E00, 1),
    (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 18), (0x2DE0, 3), (0x2E00, 0), (0x2E80, 17), (0x3000, 0),
    (0x3005, 17), (0x3008, 0), (0x3041, 16), (0x3100, 17), (0x3130, 12), (0x3190, 17), (0x31F0, 16), (0x3200, 0),
    (0x3400, 17), (0x4DC0, 0), (0x4E00, 17), (0xA000, 18), (0xA640, 3), (0xA6A0, 18), (0xA720, 1), (0xA800, 18),
    (0xAC00, 12), (0xD800, 0), (0xF900, 17), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
    (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 16), (0xFFA0, 12),
    (0xFFE0, 0), (0x10000, 18), (0x20000, 17), (0x32000, 18),
)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter (category L), for all of Unicode."""
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x32000)] +
                                 [False] * (0x110000 - 0x32000), dtype=bool))
    return _LETTERS[0]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and value of each code point of UTF-8 bytes."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.int32)
    cp = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    b = lead[wide]
    n = 1 + (b >= 0xE0) + (b >= 0xF0)
    v = b & (0x3F >> n)
    for i in range(1, 4):
        more = n >= i
        v[more] = v[more] << 6 | (buf[at[wide[more]] + i] & 0x3F)
    cp[wide] = v
    return at, cp


_FROM = np.array([a for a, _ in RANGES], dtype=np.int32)
_SCRIPT = np.array([s for _, s in RANGES], dtype=np.uint8)


@dataclass
class Text:
    """Words of a slice: n-gram buckets of every byte, letters and scripts."""
    first: np.ndarray   # first word of each text
    starts: np.ndarray  # byte span of each word
    ends: np.ndarray
    grams: list[np.ndarray]  # bucket of the n-gram that ends at each byte
    letters: np.ndarray  # letters of each word
    scripts: np.ndarray  # bit set of each word's scripts


def analyse(col: pa.Array) -> Text:
    buf, off = utf8(col)
    starts, ends, first = word_spans(buf, off)
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    # a word's n-grams begin with its leading blank: bytes between words count as blanks
    low[(buf == 32) | ((buf >= 9) & (buf <= 13))] = 32
    b = low.astype(U64)
    grams, acc = [], np.zeros(len(b), dtype=U64)
    for i, n in enumerate(GRAMS):
        shifted = np.full(len(b), U64(32))
        shifted[i:] = b[:len(b) - i] if i else b
        acc = acc | shifted << U64(8 * i)
        grams.append((mix(acc, n) & U64(BUCKETS - 1)).astype(np.int32))
    at, cp = code_points(buf)
    is_letter = letters()[cp]
    at, cp = at[is_letter], cp[is_letter]
    word = np.searchsorted(starts, at, side="right") - 1
    n = np.bincount(word, minlength=len(starts)).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    script = _SCRIPT[np.searchsorted(_FROM, cp, side="right") - 1]
    scripts = np.zeros(len(starts), dtype=np.int64)
    for s in np.unique(script).tolist():
        if s:
            scripts[np.unique(word[script == s])] |= 1 << s
    return Text(first, starts, ends, grams, n, scripts)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # float32 [len(GRAMS) * BUCKETS, langs]
    scripts: np.ndarray  # bit set of each language's scripts


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows whose language is not null."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    width = len(GRAMS) * BUCKETS + len(SCRIPTS)
    if not langs:
        return Model([], np.zeros((len(GRAMS) * BUCKETS, 0), np.float32), np.zeros(0, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), width), dtype=np.int64)
        for b in batches:
            for part in slices(b, "text", STEP):
                t = analyse(part.column("text"))
                own = np.array([bisect.bisect_left(langs, x) for x in part.column("lang").to_pylist()], dtype=np.int64)
                of_word = np.repeat(own, np.diff(t.first))
                use = np.flatnonzero(t.letters)
                size = (t.ends - t.starts)[use]
                at = np.repeat(t.starts[use], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                who = np.repeat(of_word[use], size)
                for l in np.unique(own).tolist():
                    mine = at[who == l]
                    for i, g in enumerate(t.grams):
                        sums[l, i * BUCKETS:(i + 1) * BUCKETS] += np.bincount(g[mine], minlength=BUCKETS)
                    words = use[of_word[use] == l]
                    for s in range(len(SCRIPTS)):
                        have = words[(t.scripts[words] >> s & 1) == 1]
                        sums[l, len(GRAMS) * BUCKETS + s] += t.letters[have].sum()
        l, at = np.nonzero(sums)
        for i in range(0, len(l), 100_000):
            cut = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(l[cut].astype(np.int32)), pa.array(at[cut].astype(np.int32)),
                                              pa.array(sums[l[cut], at[cut]])], ["lang", "at", "n"])

    rows = known.mapInArrow(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(langs), width))
    total[rows["lang"].to_numpy(), rows["at"].to_numpy()] = rows["n"].to_numpy()
    grams = total[:, :len(GRAMS) * BUCKETS].reshape(len(langs), len(GRAMS), BUCKETS) + SMOOTH
    log = np.log(grams / grams.sum(axis=2, keepdims=True)) / len(GRAMS)
    seen = total[:, len(GRAMS) * BUCKETS:]
    share = seen >= SCRIPT_SHARE * np.maximum(seen.sum(axis=1, keepdims=True), 1)
    scripts = ((share & (seen > 0)) << np.arange(len(SCRIPTS))).sum(axis=1)
    weights = log.transpose(1, 2, 0).reshape(-1, len(langs)).astype(np.float32)
    return Model(langs, np.ascontiguousarray(weights), scripts.astype(np.int64))


def word_scores(t: Text, m: Model) -> np.ndarray:
    """Score of each word under each language; languages that have none of a
    word's scripts are no candidates for it (unless no language has)."""
    if not len(t.starts):
        return np.zeros((0, len(m.langs)), dtype=np.float32)
    total = np.zeros((len(t.grams[0]) + 1, len(m.langs)), dtype=np.float32)
    for i, g in enumerate(t.grams):
        total[:-1] += m.weights[g + i * BUCKETS]
    cut = np.empty(2 * len(t.starts), dtype=np.int64)
    cut[0::2], cut[1::2] = t.starts, t.ends
    s = np.add.reduceat(total, cut, axis=0)[0::2]
    s[t.letters == 0] = 0
    fits = (t.scripts[:, None] & m.scripts[None, :]) != 0
    out = ~fits & fits.any(axis=1)[:, None]
    s[out] = -1e6
    return s - s.max(axis=1, keepdims=True)


def viterbi(s: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of each word: best path of each text.  All texts of the slice
    advance together, longest first, so a step is one array operation."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], first[:-1][order]
    label = np.zeros(len(s), dtype=np.int16)
    if not len(s):
        return label
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # texts of more than t words
    score = np.zeros((len(n), s.shape[1]), dtype=np.float32)
    stay = np.zeros(s.shape, dtype=bool)  # the word's best path keeps the language of the word before
    jump = np.zeros(len(s), dtype=np.int16)
    for t, k in enumerate(active.tolist()):
        at = begin[:k] + t
        prev = score[:k]
        if t:
            top = prev.argmax(axis=1)
            jump[at] = top
            leave = prev[np.arange(k), top][:, None] - switch
            stay[at] = prev >= leave
            prev = np.maximum(prev, leave)
        now = prev + s[at]
        score[:k] = now - now.max(axis=1, keepdims=True)
    cur = score.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        label[at] = cur[:k]
        cur[:k] = np.where(stay[at, cur[:k]], cur[:k], jump[at])
    return label


SPANS = "array<struct<start: int, words: int, lang: string>>"


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """Add lang_pred, score and, if wanted, spans (first word, words, lang)."""
    new = ["lang_pred", "score", *(["spans"] if spans else [])]
    rest = [c for c in docs.columns if c not in new]
    schema = docs.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                         *([F.lit(None).cast(SPANS).alias("spans")] if spans else [])).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], dtype=object)
        for b in batches:
            for part in slices(b, text, STEP):
                t = analyse(part.column(text))
                rows = part.num_rows
                who = np.repeat(np.arange(rows), np.diff(t.first))
                label = viterbi(word_scores(t, m), t.first, switch) if m.langs else np.zeros(len(t.starts), np.int16)
                width = max(len(m.langs), 1)
                mass = np.bincount(who * width + label, weights=t.letters, minlength=rows * width).reshape(rows, width)
                total = mass.sum(axis=1)
                none = (total == 0) | (not m.langs)
                pred = np.where(none, len(m.langs), mass.argmax(axis=1))
                score = np.where(none, 0.0, mass.max(axis=1) / np.maximum(total, 1))
                cols = [*(part.column(c) for c in rest), pa.array(names[pred], pa.string()), pa.array(score)]
                if spans:
                    cut = np.ones(len(label), dtype=bool)
                    cut[1:] = (label[1:] != label[:-1]) | (who[1:] != who[:-1])
                    at = np.flatnonzero(cut)
                    size = np.diff([*at, len(label)])
                    of = who[at]
                    ok = ~none[of]
                    made = [[] for _ in range(rows)]
                    for d, i, n, l in zip(of[ok].tolist(), (at - t.first[of])[ok].tolist(), size[ok].tolist(), label[at][ok].tolist()):
                        made[d].append({"start": i, "words": n, "lang": m.langs[l]})
                    cols.append(pa.array(made, kind))
                yield pa.RecordBatch.from_arrays(cols, [*rest, *new])

    return docs.mapInArrow(run, schema)
