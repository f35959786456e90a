import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from wavespark.llm import decontaminate as dc
from wavespark.llm.queries import QUERIES

VOCAB = [f"w{i}" for i in range(5000)]


def passage(rnd, n):
    return rnd.choices(VOCAB, k=n)


def analyse(ws):
    buf, off = dc.utf8(pa.array([" ".join(ws)]))
    starts, ends, _ = dc.word_spans(buf, off)
    return dc.span_hashes(buf, starts, ends)


def words(t):
    out, w = [], ""
    for c in (t or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if w:
                out.append("".join(x.lower() if x.isascii() else x for x in w))
            w = ""
        else:
            w += c
    return out


def brute(doc, item):
    """Any alignment with 12 words between equal ones, 80 % of them equal,
    that holds a window on which one mask agrees."""
    d, b = words(doc), words(item)
    if not b:
        return False
    if len(b) < dc.SPAN:
        return any(d[i:i + len(b)] == b for i in range(len(d) - len(b) + 1))
    for line in range(-len(b) + 1, len(d)):
        same = [0 <= line + k < len(d) and d[line + k] == b[k] for k in range(len(b))]
        if not any(all(same[k + i] for i, c in enumerate(m) if c == "1")
                   for m in dc.MASKS for k in range(len(b) - dc.SPAN + 1)
                   if line + k >= 0 and line + k + dc.SPAN <= len(d)):
            continue
        at = [k for k, s in enumerate(same) if s]
        for i in range(len(at)):
            for j in range(i, len(at)):
                n = at[j] - at[i] + 1
                if n >= dc.MIN_WORDS and j - i + 1 >= dc.SHARE * n - 1e-9:
                    return True
    return False


def overlaps(doc, item):
    """Any alignment with 12 words between equal ones, 80 % of them equal."""
    d, b = words(doc), words(item)
    for line in range(-len(b) + 1, len(d)):
        at = [k for k in range(len(b)) if 0 <= line + k < len(d) and d[line + k] == b[k]]
        if any(y - x + 1 >= dc.MIN_WORDS and j - i + 1 >= dc.SHARE * (y - x + 1) - 1e-9
               for i, x in enumerate(at) for j, y in enumerate(at)):
            return True
    return False


def test_masks_leave_out_no_overlap():
    for n in range(dc.MIN_WORDS, 2 * dc.MIN_WORDS):
        if int((1 - dc.SHARE) * n + 1e-9) == int((1 - dc.SHARE) * (n - 1) + 1e-9) and n > dc.MIN_WORDS:
            continue  # holds a shorter one with as many substitutions
        for changed in itertools.combinations(range(n), int((1 - dc.SHARE) * n + 1e-9)):
            assert any(not any(m[c - k] == "1" for c in changed if k <= c < k + dc.SPAN)
                       for k in range(n - dc.SPAN + 1) for m in dc.MASKS), (n, changed)


def test_every_overlap_is_found():
    rnd = random.Random(8)
    items, docs = [], []
    for i in range(300):
        items.append(passage(rnd, rnd.randrange(13, 60)))
        w = list(items[-1])
        n, k = (range(4, len(w), 5), range(3, len(w), 4), rnd.sample(range(len(w)), len(w) // 5))[i % 3], rnd.randrange(20)
        for c in n:
            w[c] = "changed"
        docs.append(passage(rnd, k) + w + passage(rnd, rnd.randrange(20)))
    hashes = [analyse(t) for t in (*items, *docs)]
    index = dc.Index(list(enumerate(hashes[:300])))
    first = np.concatenate([[0], np.cumsum([len(h) for h in hashes[300:]])])
    got = {(d, i) for d, i, *_ in index.find(np.concatenate(hashes[300:]), first)}
    want = {(d, d) for d in range(300) if overlaps(" ".join(docs[d]), " ".join(items[d]))}
    assert want <= got and len(want) > 150
    assert all(overlaps(" ".join(docs[d]), " ".join(items[i])) for d, i in got)


def test_longest_overlap():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        same = rnd.random(rnd.integers(1, 40)) < 0.7
        at = np.flatnonzero(same)
        best = max((at[j] - at[i] + 1 for i in range(len(at)) for j in range(i, len(at))
                    if j - i + 1 >= dc.SHARE * (at[j] - at[i] + 1) - 1e-9), default=0)
        start, n, equal = dc.longest_overlap(same)
        assert n == best
        if n:
            assert equal == same[start:start + n].sum() >= dc.SHARE * n - 1e-9


@pytest.mark.parametrize("block", [dc.BLOCK_WINDOWS, 30])
def test_planted(spark, block):
    rnd = random.Random(4)
    items = [(i, " ".join(passage(rnd, rnd.choice([5, 14, 30, 60])))) for i in range(20)] + [(90, None), (91, " "), (None, "q r s t")]
    docs = []
    for i in range(120):
        body = passage(rnd, rnd.randrange(0, 120))
        kind = i % 6
        if kind:
            w = words(items[i % 20][1])
            if kind == 2 and len(w) > 12:
                w[rnd.randrange(len(w))] = "changed"
            if kind == 3:
                w = [("x" if rnd.random() < 0.15 else c) for c in w]
            if kind == 4:
                w = w[:len(w) // 2]
            if kind == 5:
                w = [c.upper() for c in w]
            at = rnd.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "q r s t"), (0, docs[0][1]), (503, "long " * 30000 + items[3][1])]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = dc.find_overlaps(frame, bench, block_windows=block).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id == 503:
            assert 3 in {h.item_id for h in r.hits}
            continue
        found = {None if h.item_id == -(2**63) else h.item_id for h in r.hits}
        assert found == {i for i, t in items if brute(r.text, t)}, r.doc_id
    clean = dc.decontaminate(frame, bench, block_windows=block)
    assert clean.columns == frame.columns and clean.count() == sum(not r.hits for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, bench).count() == 1
    assert dc.decontaminate(docs.limit(0), bench).count() == 0


def test_query_finds_every_whole_passage(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: {h.item_id for h in r.hits} for r in QUERIES["op2_spaced_seeds"](spark, sf).collect()}
    bench = [(r.item_id, " ".join(words(r.text))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        t = " " + " ".join(words(r.text)) + " "
        assert {i for i, b in bench if f" {b} " in t} <= got[r.doc_id]
    assert sum(map(bool, got.values())) < 0.1 * len(got)


def test_repetitive_texts_are_cheap_and_whole():
    """Equal words and short periods: one hit, in seconds; the same overlaps as
    by all alignments."""
    import time
    begin = time.time()
    index = dc.Index([(1, analyse(["a"] * 100))])
    hits = index.find(analyse(["a"] * 1_000_000), np.array([0, 1_000_000]))
    assert [(h[1], h[3], h[4]) for h in hits] == [(1, 100, 100)] and time.time() - begin < 30
    rnd = random.Random(21)
    parts = [["a"] * 15, list("ab") * 8, list("abc") * 7, list("aab") * 6, ["x1", "x2", "x3"], list("b") * 13]
    for _ in range(150):
        docs = [[w for _ in range(rnd.randrange(1, 5)) for w in rnd.choice(parts)] for _ in range(4)]
        items = [[w for _ in range(rnd.randrange(1, 4)) for w in rnd.choice(parts)] for _ in range(3)]
        items = [i for i in items if len(i) >= dc.SPAN]
        if not items:
            continue
        hashes = [analyse(t) for t in docs]
        first = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        got = {(d, i): n for d, i, _, n, _ in dc.Index([(k, analyse(t)) for k, t in enumerate(items)]).find(np.concatenate(hashes), first)}
        for d, doc in enumerate(docs):
            for i, item in enumerate(items):
                best = 0
                for line in range(-len(item) + 1, len(doc)):
                    lo, hi = max(line, 0), min(line + len(item), len(doc))
                    same = np.array([doc[k] == item[k - line] for k in range(lo, hi)])
                    best = max(best, dc.longest_overlap(same)[1])
                assert got.get((d, i), 0) == (best if best >= dc.MIN_WORDS else 0), (doc, item)
