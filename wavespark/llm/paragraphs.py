"""Substring dedup on paragraphs: MinHash bands, exact check, components.

Paragraphs are the lines of a text.  Those of at least ``MIN_WORDS`` words are
described by their set of 5-word shingles; equal sets are one class at once.
MinHash signatures of the classes are cut into bands, as many as ``tune`` finds
necessary for the wanted recall at the threshold; classes that collide in a
band meet in bounded blocks, where colliding pairs are verified by exact
Jaccard similarity.  Of every component of equal and linked paragraphs the
first (smallest id, then position) stays and the others are removed.

A passage may also stand inside lines that differ around it, where the
paragraphs as a whole are not alike.  So each text is also fingerprinted by
hashes of ``WINDOW`` consecutive words, winnowed so that any common run of
``2 * WINDOW - 1`` words has a common fingerprint.  All windows of ``MIN_RUN``
words around a fingerprint that several documents have are compared, each with
all others of its hash: a window stays in the first document that has it and is
removed from all later ones, so that a run of ``MIN_RUN`` words or more goes
whole, whichever of the earlier documents has it and however others vary it.
Text that repeats itself stays where it is longest.

Rows: null, empty and wordless texts stay as they are; rows that repeat id and
text are one document and no copies of each other; ties of ids go to the
smaller hash of id and text; a null id comes last; an empty table gives an
empty result; other columns pass through, columns named like an output are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.util import bounded_broadcast
from .common import (_BASE, _INV, _INVERSE, _POW, U64, _powers, distinct_per_text, drop_saved, mix, saved, shingles, slices,
                     span_hashes, utf8, word_spans)
from .components import connected_components
from .groups import block_pairs, common_elements, link_blocks, share_any
from .ngram_join import text_key
from .order_minhash import MULTIPLIERS

SHINGLE, NUM, DEN = 5, 80, 100
MIN_WORDS, MIN_RUN, WINDOW = 25, 50, 24
RECALL, ROWS = 0.999, 4
STEP = 3 << 20
LAST = 2**63 - 1


def tune(threshold: float = NUM / DEN, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima so that a pair at the threshold collides with
    probability ``recall`` at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


BANDS = tune()


def paragraphs(buf, off, starts, first, h):
    """Words and first words of all long lines, and each one's text and line."""
    newline = np.flatnonzero(buf == 10)
    who = np.repeat(np.arange(len(off) - 1), np.diff(first))
    line = np.searchsorted(newline, starts)
    cut = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (who[1:] != who[:-1])])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(h)))
    cut, size = cut[size >= MIN_WORDS], size[size >= MIN_WORDS]
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(cut - begin[:-1], size) + np.arange(begin[-1])
    return h[at], begin, who[cut], (line[cut] - np.searchsorted(newline, off[who[cut]])).astype(np.int32)


def bands(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """int64 [paragraphs, BANDS]: keys of the bands of each MinHash signature."""
    n = len(begin) - 1
    out = np.zeros((n, BANDS), dtype=U64)
    if not n:
        return out.view(np.int64)
    key = np.empty_like(x)
    for b in range(BANDS):
        acc = np.full(n, U64(b))
        for r in range(ROWS):
            np.multiply(x, MULTIPLIERS[b * ROWS + r], out=key)
            acc = mix(acc ^ np.minimum.reduceat(key, begin[:-1]))
        out[:, b] = acc
    return out.view(np.int64)


def rolling(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of each window of so many consecutive words."""
    n = len(h) - words + 1
    if n < 1:
        return np.zeros(0, dtype=U64)
    pw, inv = (_POW, _INV) if len(h) < len(_POW) else (_powers(len(h) + 1, _BASE), _powers(len(h) + 1, _INVERSE))
    acc = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * pw[:len(h)], dtype=U64, out=acc[1:])
    return mix((acc[words:] - acc[:-words]) * inv[:n], 17)


def stretch(h: np.ndarray, lo: int, hi: int, run: int) -> tuple[int, int, int] | None:
    """Period and ends of the text around h[lo:hi] that repeats itself, if it
    does with a period of ``WINDOW`` words at most."""
    for d in range(1, min(WINDOW, hi - lo - 1) + 1):
        if h[lo] == h[lo + d] and (h[lo + d:hi] == h[lo:hi - d]).all():
            break
    else:
        return None
    near = slice(max(lo - 2 * WINDOW, 0), lo), slice(hi, min(hi + 2 * WINDOW, len(h)))
    before = h[near[0]] == h[near[0].start + d:near[0].stop + d]
    after = h[near[1]] == h[near[1].start - d:near[1].stop - d]
    lo -= int(np.argmin(np.append(before[::-1], False)))
    hi += int(np.argmin(np.append(after, False)))
    return (d, lo, hi) if hi - lo >= run else None


def windows(h: np.ndarray, first: np.ndarray, own: np.ndarray, pos: np.ndarray, reach: np.ndarray, run: int):
    """(text, hash, position, words, short) of the windows of ``run`` words
    around the fingerprints ``own``, ``pos``, ``reach``.  Where text repeats
    itself they stand for all of it, and short is less the longer it is."""
    v = rolling(h, run)
    size = np.diff(first)
    delta = np.zeros(len(h) + 2, dtype=np.int64)
    lo, hi = np.maximum(pos - (run - WINDOW), 0), np.minimum(pos + reach, size[own] - run)
    some = lo <= hi
    np.add.at(delta, (first[own] + lo)[some], 1)
    np.add.at(delta, (first[own] + hi + 1)[some], -1)
    wanted = np.cumsum(delta)[:len(v)] > 0
    long = []
    for i in np.flatnonzero(reach > 0).tolist():
        text = h[first[own[i]]:first[own[i] + 1]]
        found = stretch(text, int(pos[i]), int(pos[i] + reach[i] + WINDOW), run)
        if found:
            d, a, b = found
            at = int(first[own[i]]) + a
            wanted[at:at + b - a - run + 1] = False
            long += [(int(own[i]), int(x), a, b - a, a - b) for x in v[at:at + min(d, b - a - run + 1)].view(np.int64)]
    at = np.flatnonzero(wanted)
    who = np.searchsorted(first, at, side="right") - 1
    cols = who, v[at].view(np.int64), at - first[who], np.full(len(at), run), np.zeros(len(at), np.int64)
    if long:
        cols = [np.concatenate([c, np.array(x, np.int64)]) for c, x in zip(cols, zip(*sorted(set(long))))]
    return cols


def winnow(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position in it, hash, reach) of the winnowed windows.  Text
    that repeats itself selects one hash again and again; such a stretch is
    one entry, whose ``reach`` is the distance to the last of its windows."""
    n = len(h) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none
    v = rolling(h, WINDOW)
    bits = U64(max(int(n).bit_length(), 22))
    low = (U64(1) << bits) - U64(1)
    least = (v & ~low) | np.arange(n, dtype=U64)
    span = 1
    while span * 2 <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOW:
        least = np.minimum(least[:len(least) - (WINDOW - span)], least[WINDOW - span:])
    who = np.repeat(np.arange(len(first) - 1), np.diff(first))
    j = np.arange(len(least))
    inside = j + 2 * WINDOW - 1 <= first[1:][who[:len(least)]]
    at = np.unique((least[inside] & low).astype(np.int64))
    own, fp = who[at], v[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (fp[1:] != fp[:-1]) | (own[1:] != own[:-1]) | (at[1:] - at[:-1] > WINDOW)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    own = own[head]
    return own, at[head] - first[:-1][own], fp[head].view(np.int64), at[last] - at[head]


PAR = "array<struct<at: int, size: int, s1: bigint, s2: bigint, bands: array<bigint>>>"


def _list(own: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    off = np.searchsorted(own, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), values)


def _analyse(col: pa.Array):
    buf, off = utf8(col)
    starts, ends, first = word_spans(buf, off)
    return buf, off, starts, ends, first, span_hashes(buf, starts, ends)


def left_over(part: pa.RecordBatch, buf, off, starts, first) -> tuple[np.ndarray, np.ndarray]:
    """Which words stay once the lines in the column ``lines`` are gone, and
    the first of them of each text."""
    keep = np.ones(len(starts), dtype=bool)
    newline = np.flatnonzero(buf == 10)
    for d, ls in enumerate(part.column("lines").to_pylist()):
        if ls:
            w = slice(first[d], first[d + 1])
            keep[w] = ~np.isin(np.searchsorted(newline, starts[w]) - np.searchsorted(newline, off[d]), ls)
    return keep, np.concatenate([[0], np.cumsum(keep)])[first]


def texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(text_key(key, text).alias("node"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """node, id, fp, pos, reach of what is left of every text without its
    removed lines (node, lines); positions count the words left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", STEP):
                buf, off, starts, _, first, h = _analyse(part.column("text"))
                keep, first = left_over(part, buf, off, starts, first)
                own, pos, fp, reach = winnow(h[keep], first)
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(own), part.column("id").take(own), pa.array(fp),
                     pa.array(pos.astype(np.int32)), pa.array(reach.astype(np.int32))], ["node", "id", "fp", "pos", "reach"])

    return saved(texts(docs, key, text).join(bounded_broadcast(lines), "node", "left").mapInArrow(
        run, "node long, id long, fp long, pos int, reach int"), "passages")


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """node, id and par (long lines) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", STEP):
                buf, off, starts, _, first, h = _analyse(part.column("text"))
                w, begin, who, line = paragraphs(buf, off, starts, first, h)
                x, at = distinct_per_text(*shingles(w, begin, SHINGLE))
                sums = [np.add.reduceat(mix(x, i), at[:-1]).view(np.int64) if len(x) else np.zeros(0, np.int64) for i in (1, 2)]
                keys = bands(x, at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                par = pa.StructArray.from_arrays(
                    [pa.array(line), pa.array(np.diff(at).astype(np.int32)), *map(pa.array, sums), flat],
                    ["at", "size", "s1", "s2", "bands"])
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("id"), _list(who, part.num_rows, par)],
                                                 ["node", "id", "par"])

    return saved(texts(docs, key, text).mapInArrow(run, f"node long, id long, par {PAR}"), "paragraphs")


def verify(c: dict[str, list]) -> np.ndarray:
    size = np.array([len(s) for s in c["tokens"]])
    ok = np.minimum.outer(size, size) * DEN >= np.maximum.outer(size, size) * NUM
    np.fill_diagonal(ok, False)
    ok &= share_any(c["bands"])
    both = common_elements(c["tokens"]) if ok.any() else np.zeros_like(size, shape=ok.shape)
    return ok & (both * DEN >= (np.add.outer(size, size) - both) * NUM)


def repeated_paragraphs(table: DataFrame, docs: DataFrame, key: str, text: str, scratch: list) -> DataFrame:
    """(node, at): the lines to remove.  Tables it reads are added to ``scratch``."""
    par = table.select("node", "id", F.explode("par").alias("p")).select("node", "id", "p.*").withColumn(
        "pid", F.xxhash64("node", "at"))
    classes = par.groupBy("s1", "s2", "size").agg(F.min("pid").alias("class"))
    postings = par.join(classes.select(F.col("class").alias("pid")), "pid", "left_semi").select(
        F.col("pid").alias("node"), F.lit(0).alias("rank"), F.col("size").cast("long").alias("n"),
        F.explode("bands").alias("key")).distinct()
    pairs = saved(block_pairs(postings), "paragraph-blocks")
    scratch.append(pairs)
    wanted = pairs.select(F.col("node").alias("pid")).distinct().join(par.select("pid", "node", "at"), "pid").groupBy(
        "node").agg(F.collect_set(F.struct("at", "pid")).alias("take"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", STEP):
                buf, off, starts, _, first, h = _analyse(part.column("text"))
                w, begin, who, line = paragraphs(buf, off, starts, first, h)
                x, at = distinct_per_text(*shingles(w, begin, SHINGLE))
                keys = bands(x, at)
                pid = {(d, t["at"]): t["pid"] for d, ts in enumerate(part.column("take").to_pylist()) for t in ts}
                mine = [(i, pid[k]) for i, k in enumerate(zip(who.tolist(), line.tolist())) if k in pid]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for _, p in mine], pa.int64()),
                     pa.array([x[at[i]:at[i + 1]].view(np.int64) for i, _ in mine], pa.list_(pa.int64())),
                     pa.array([keys[i] for i, _ in mine], pa.list_(pa.int64()))], ["node", "tokens", "bands"])

    chosen = docs.select(text_key(key, text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        bounded_broadcast(wanted), "node")
    full = chosen.mapInArrow(sets, "node long, tokens array<long>, bands array<long>")
    roots = connected_components(link_blocks(pairs, full, verify)).select(F.col("node").alias("class"), "root")
    rows = par.join(classes, ["s1", "s2", "size"]).join(roots, "class", "left").select(
        "node", "at", "id", F.coalesce("root", "class").alias("root"))
    place = F.struct("id", "node", "at")
    kept = rows.groupBy("root").agg(F.min(place).alias("kept"), F.max(place).alias("other")).where("kept <> other")
    return rows.join(kept.select("root", "kept"), "root").where(place != F.col("kept")).select("node", "at")


def repeated_runs(lines: DataFrame, docs: DataFrame, key: str, text: str, scratch: list) -> DataFrame:
    """(node, start, end): word ranges that repeat an earlier document's, in
    what is left without ``lines``, so that one copy of everything stays."""
    least = MIN_RUN
    win = fingerprints(docs, lines, key, text)
    scratch.append(win)
    shared = win.groupBy("fp").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("fp")
    asked = win.join(shared, "fp", "left_semi").groupBy("node").agg(F.collect_set(F.struct("pos", "reach")).alias("take"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", STEP):
                buf, off, starts, _, first, h = _analyse(part.column("text"))
                keep, first = left_over(part, buf, off, starts, first)
                take = part.column("take")
                own = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(take).to_numpy())
                take = take.flatten()
                own, *cols = windows(h[keep], first, own, *(take.field(i).to_numpy().astype(np.int64) for i in (0, 1)), least)
                own = pa.array(own)
                for i in range(0, len(own), 100_000):
                    some = own[i:i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node").take(some), part.column("id").take(some),
                         *(pa.array(c[i:i + 100_000], k) for c, k in zip(cols, (pa.int64(), *[pa.int32()] * 3)))],
                        ["node", "id", "hash", "pos", "words", "short"])

    chosen = texts(docs, key, text).join(bounded_broadcast(asked), "node").join(bounded_broadcast(lines), "node", "left")
    rows = saved(chosen.mapInArrow(around, "node long, id long, hash long, pos int, words int, short int"), "run-windows")
    scratch.append(rows)
    # the first stays; of stretches that repeat themselves the first longest one
    first = rows.groupBy("hash").agg(F.min(F.struct("short", "id", "node")).alias("f"), F.min("node").alias("lo"),
                                     F.max("node").alias("hi")).where("lo <> hi").select("hash", F.col("f.node").alias("from"))
    gone = F.col("node") != F.col("from")
    marked = rows.join(first, "hash").where(gone | (F.col("short") < 0)).groupBy("node").agg(
        F.collect_set(F.struct("pos", "words", gone.alias("gone"))).alias("s"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [], [], []
            for node, s in zip(b.column("node").to_pylist(), b.column("s")):
                pos, words, lost = (s.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                delta = np.zeros((2, int((pos + words).max()) + 1), dtype=np.int64)
                for side, some in enumerate((lost, ~lost)):
                    np.add.at(delta[side], pos[some], 1)
                    np.add.at(delta[side], (pos + words)[some], -1)
                there, kept = np.cumsum(delta, axis=1) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], there & ~kept, [False]]).astype(np.int8))).reshape(-1, 2)
                for o, v in zip(out, ([node] * len(edge), *edge.T.tolist())):
                    o.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int32(), pa.int32()))],
                                             ["node", "start", "end"])

    return marked.mapInArrow(merge, "node long, start int, end int")


def cut(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> str:
    """The text without the words of ``gone``; where it is cut one gap stays,
    a line break if there was one."""
    if gone.all():
        return ""
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    out, at = [], 0
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        before = raw[ends[i - 1]:starts[i]] if i else b""
        after = raw[ends[j - 1]:starts[j]] if j < len(starts) else raw[ends[j - 1]:]
        out.append(raw[at:ends[i - 1]] if i else raw[at:starts[0]])
        if i:
            broken = j < len(starts) and b"\n" in raw[ends[i - 1]:starts[j]]
            out.append(after if j == len(starts) or b"\n" in after else b"\n" if broken and b"\n" not in before else before)
        at = starts[j] if j < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated paragraphs and passages cut out of the text;
    adds n_words, n_removed (words) and removed (first word, words)."""
    new = {"n_words": "long", "n_removed": "long", "removed": "array<struct<start: int, words: int>>"}
    rest = [c for c in docs.columns if c not in new]
    table, scratch = describe(docs, key, text), []
    lines = repeated_paragraphs(table, docs, key, text, scratch).groupBy("node").agg(F.collect_set("at").alias("lines"))
    lines = saved(lines, "paragraph-lines")
    drop_saved(table, *scratch)
    scratch = [lines]
    runs = repeated_runs(lines, docs, key, text, scratch).groupBy("node").agg(
        F.collect_list(F.struct("start", "end")).alias("__runs"))
    edits = saved(lines.join(runs, "node", "full").withColumnsRenamed({"node": "__node", "lines": "__lines"}), "paragraph-edits")
    drop_saved(*scratch)
    frame = docs.select(*rest).withColumn("__node", text_key(key, text)).join(
        bounded_broadcast(edits), "__node", "left").drop("__node")
    schema = docs.select(*rest, *(F.lit(None).cast(t).alias(c) for c, t in new.items())).schema
    spans = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text, STEP):
                buf, off = utf8(part.column(text))
                starts, ends, first = word_spans(buf, off)
                texts, removed = part.column(text), [[] for _ in range(part.num_rows)]
                count = np.zeros(part.num_rows, dtype=np.int64)
                todo = [(d, l or [], r or []) for d, (l, r) in enumerate(zip(
                    part.column("__lines").to_pylist(), part.column("__runs").to_pylist())) if l or r]
                if todo:
                    texts = texts.to_pylist()
                for d, ls, rs in todo:
                    at, to = starts[first[d]:first[d + 1]] - off[d], ends[first[d]:first[d + 1]] - off[d]
                    raw = buf[off[d]:off[d + 1]]
                    gone = np.isin(np.searchsorted(np.flatnonzero(raw == 10), at), ls)
                    left = np.flatnonzero(~gone)
                    for r in rs:
                        gone[left[r["start"]:r["end"]]] = True
                    texts[d] = cut(raw.tobytes(), at, to, gone)
                    count[d] = gone.sum()
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    removed[d] = [{"start": i, "words": j - i} for i, j in edge.reshape(-1, 2).tolist()]
                done = pa.array(texts, pa.string()) if todo else texts
                yield pa.RecordBatch.from_arrays(
                    [*(done if c == text else part.column(c) for c in rest), pa.array(np.diff(first)), pa.array(count),
                     pa.array(removed, spans)], [*rest, *new])

    return frame.mapInArrow(run, schema)
