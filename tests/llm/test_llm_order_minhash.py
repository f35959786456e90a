import hashlib
import random

import numpy as np
import pyarrow as pa

from wavespark.llm import order_minhash as omh
from wavespark.llm.common import mix, shingles, words
from wavespark.llm.queries import QUERIES


def brute(text, k=2, l=2, m=64):
    """The definition, one k-mer at a time."""
    h, first = words(pa.array([text]))
    x, _ = shingles(h, first, k)
    seen, marked = {}, []
    for v in x.tolist():
        seen[v] = seen.get(v, -1) + 1
        marked.append(int(mix(np.array([(v + seen[v] * 0xA24BAED4963EE407) % 2**64], dtype=np.uint64))[0]))
    if not marked:
        return [0] * m
    out = []
    for j in range(m):
        a = int(omh.MULTIPLIERS[j])
        ranked = sorted(range(len(marked)), key=lambda i: ((marked[i] * a % 2**64) >> 24, i))[:l]
        acc = 0
        for i, p in enumerate([None] * (l - len(ranked)) + sorted(ranked)):
            v = i if p is None else marked[p]
            acc = int(mix(np.array([(acc + v) % 2**64], dtype=np.uint64), 13)[0])
        out.append(acc % 65535 + 1)
    return out


def test_sketches_equal_the_definition():
    rnd = random.Random(1)
    vocab = "a b c d e the of on é".split()
    texts = ["", "one", "one two", "x x x x x x"] + [" ".join(rnd.choices(vocab, k=rnd.randrange(80))) for _ in range(40)]
    got = omh.sketches(pa.array(texts))
    assert got.tolist() == [brute(t) for t in texts]


def test_order_matters():
    w = [f"w{i}" for i in range(400)]
    a, b = " ".join(w), " ".join(w[200:] + w[:200])
    near = " ".join(w[:199] + ["new"] + w[200:])
    s = omh.sketches(pa.array([a, b, near]))
    moved, edited = (float(omh.likeness(s[:1], s[i:i + 1])[0]) for i in (1, 2))
    assert edited > 0.9 and moved < 0.8


def check(rows, got):
    order = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t)
        e = t[:n - n // 2] + nxt[:n // 2]
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        s = omh.sketches(pa.array([t, e, nxt]))
        assert (r.fingerprint, r.edited_fingerprint) == tuple(omh.to_hex(s)[:2])
        assert r.near_edited == omh.likeness(s[:1], s[1:2])[0] and r.near_next == omh.likeness(s[:1], s[2:])[0]


def test_edges(spark):
    rows = [(5, "a b c d"), (9, None), (2**62, "ü" * 9), (2**62 + 1, "z z z"), (None, ""), (-4, "last one here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, near_next string")
    check(rows, omh.compare_with_next(df).collect())
    assert omh.compare_with_next(df.limit(0)).count() == 0
    alone = omh.compare_with_next(df.where("doc_id = 5")).collect()
    check(rows[:1], alone)
    twice = omh.compare_with_next(df.union(df))
    assert twice.count() == 2 * len(rows)
    assert omh.fingerprint(df, out="near_next").count() == len(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_order_minhash"](spark, sf).collect()
    check(rows, got)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(rows)
