import random
import re

import numpy as np
import pytest

from wavespark.llm import groups, ngram_join
from wavespark.llm.components import connected_components
from wavespark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, size string, node int"


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1)))


def brute(rows, n, num, den):
    """Component (smallest id reachable) of each row, by all pairs."""
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[top(i)] = min(best.get(top(i), d), d)
    return sorted(((d, len(s), best.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(rnd, vocab=400):
    words = [f"w{i}" for i in range(vocab)]
    rows, i = [], 0
    for _ in range(12):
        base = rnd.choices(words, k=rnd.choice([1, 2, 4, 12, 60, 200]))
        for _ in range(rnd.choice([1, 2, 9, 25])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((i * 7 % 1009, " ".join(t).title() if i % 5 == 0 else "\t".join(t)))
            i += 1
    passage = " ".join(rnd.choices(words, k=60))
    rows += [(2000 + k, " ".join(rnd.choices(words, k=100)) + " " + passage) for k in range(30)]
    return rows


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (1, 70)])
def test_equals_all_pairs(spark, n, num, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK_ITEMS", 8)
    rows = corpus(random.Random(n)) + [(3000, None), (3001, ""), (3002, " \n"), (None, "w1 w2 w3 w4 w5 w6"), (3003, "w1 w2 w3 w4 w5 w6")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = ngram_join.link_documents(df, n=n, num=num, den=100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, n, num, 100)


def test_keep_one(spark):
    rows = corpus(random.Random(9)) + [(3000, None), (3001, ""), (3001, "")]
    rows += [rows[0], rows[0], (5000, "long " * 5 + "word " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    left = ngram_join.keep_one(df)
    assert left.columns == df.columns
    best = {c if n else (d, k) for k, (d, n, c) in enumerate(brute(rows, 5, 80, 100))}
    got = [r.doc_id for r in left.collect()]
    assert sorted(got, key=repr) == sorted((c if not isinstance(c, tuple) else c[0] for c in best), key=repr)
    assert ngram_join.keep_one(df.limit(0)).count() == 0
    assert ngram_join.link_documents(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(300, 400)] + [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)]
    links += [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5), (7000, None)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in links:
        if b is not None and a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: top(x) for x in list(up)}
    assert len(got) == len(up)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_elements():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(0, 50))) for _ in range(40)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    got = groups.common_elements(sets)
    off = ~np.eye(40, dtype=bool)
    assert (got[off] == np.array(want)[off]).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op10_ngram_orders"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, 3, 90, 100)
