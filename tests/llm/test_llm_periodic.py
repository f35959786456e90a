import hashlib
import random
import zlib

import numpy as np
import pytest

from wavespark.llm import periodic
from wavespark.llm.common import mix
from wavespark.llm.queries import QUERIES, with_periods

SCHEMA = "doc_id long, text string, runs int, collapsed string, start long"


def brute(words, exponent=4, shortest=6):
    """All stretches of equal words q apart, period by period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def some_words(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
    w = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // rng.randint(2, 8)))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w + w if rng.random() < 0.3 else w


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 2), (3, 1), (2, 9)])
def test_runs_equal_brute_force(exponent, shortest):
    rng = random.Random(exponent * 10 + shortest)
    for _ in range(150):
        docs = [some_words(rng) for _ in range(rng.randint(1, 8))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        h = mix(np.array([x for d in docs for x in d], dtype=np.uint64))
        s, n, q = periodic.runs(h, first, exponent, shortest)
        own = np.searchsorted(first, s, side="right") - 1
        for d, words in enumerate(docs):
            mine = own == d
            got = list(zip((s[mine] - first[d]).tolist(), n[mine].tolist(), q[mine].tolist()))
            assert got == brute(words, exponent, shortest), (words, got)


def test_many_left_words():
    """A node with more left words than suffixes near each other."""
    words = [x for i in range(300) for x in (i + 10, 1, 2, 3, 4, 5)] + [1, 2, 3, 4, 5] * 40
    words += [7] * 50 + [x for i in range(20) for x in (900 + i, *[8] * (i + 5))]
    h = mix(np.array(words, dtype=np.uint64))
    got = list(zip(*(x.tolist() for x in periodic.runs(h, np.array([0, len(words)])))))
    assert got == brute(words)


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "one", "a a a a a a", "A a A a A a A a", "x y z " * 500, "ä ö " * 9 + "\x0bü", "a a " * 6,
           "a a a a a b b b b b b c c", "long " * 30_000, "p q\r\nr\fs " * 4000 + "end"]
    out += [" ".join(map(str, some_words(rng))) for _ in range(200)]
    return out + ["a a a a a a"] * 3


def test_frame(spark):
    rows = [(i if i % 11 else None, t, i, "old", 5) for i, t in enumerate(texts())]
    got = periodic.find_runs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    want = {}
    for _, t, *_ in rows:
        w = (t or "").encode().split()
        if len(w) > 5000:
            q = len(set(w)) if t.startswith("long") else 4
            n = len(w) - (t.endswith("end"))
            want[t] = (len(w), [(0, n, q)], b" ".join(w[:q] + w[n:]).decode())
        else:
            want[t] = (len(w), brute(w), b" ".join(kept(w, brute(w))).decode())
    for r in got:
        assert r.start == 5
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == want[r.text]
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = r.text.encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w) if n < 3000 else None
        if found is None:
            continue
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want[r.doc_id] = (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
                          hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(w, found))).hexdigest())
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in QUERIES["op12_maximal_pairs"](spark, sf).collect()}
    assert {k: got[k] for k in want} == want and any(v[0] for v in want.values())


def test_planting_handles_nulls(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, None), (8, " "), (9, "b c")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in with_periods(docs).collect()} >= {(7, None)}
