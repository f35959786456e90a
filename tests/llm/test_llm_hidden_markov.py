import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wavespark.llm import hidden_markov as hm
from wavespark.llm.queries import QUERIES


def small_model(rng, k=3, symbols=50):
    norm = (lambda x, axis: x / x.sum(axis=axis, keepdims=True))
    return hm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((symbols, k)), 0))


def naive(seq, m):
    """Forward-backward of one sequence, step by step."""
    k, n = len(m.start), len(seq)
    a, b, log = np.zeros((n, k)), np.ones((n, k)), 0.0
    for t, s in enumerate(seq):
        a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * m.emit[s]
        z = a[t].sum()
        a[t] /= z
        log += math.log(z)
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[seq[t + 1]] * b[t + 1])
        b[t] /= b[t].sum()
    g = a * b
    g /= g.sum(axis=1, keepdims=True)
    x = np.zeros((k, k))
    for t in range(n - 1):
        e = a[t][:, None] * m.move * (m.emit[seq[t + 1]] * b[t + 1])[None]
        x += e / e.sum()
    return log, g, x


def test_kernels_equal_the_definition():
    rng = np.random.default_rng(5)
    m = small_model(rng)
    sizes = [1, 2, hm.SEGMENT - 1, hm.SEGMENT, hm.SEGMENT + 1, 3 * hm.SEGMENT, 700, 1, 2 * hm.SEGMENT + 5]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    sym = rng.integers(0, 50, begin[-1])
    emit, top = hm.scaled(m.emit)
    gamma, order, starts, moves, log = hm.posteriors(emit[sym], begin, m)
    assert np.sort(order).tolist() == list(range(len(sym)))
    assert np.allclose(hm.by_symbol(sym[order], gamma, 50).sum(axis=1), np.bincount(sym, minlength=50), rtol=1e-4)
    text = np.empty((len(sym), 3))
    text[order] = gamma.T
    gamma = text
    assert np.allclose(starts, gamma[begin[:-1]].sum(axis=0), rtol=1e-5)
    got = hm.log_likelihood(emit[sym], top[sym], begin, m)
    x = np.zeros((3, 3))
    for i in range(len(sizes)):
        at = slice(begin[i], begin[i + 1])
        want, g, e = naive(sym[at], m)
        assert got[i] == pytest.approx(want, rel=1e-5) == log[i] + top[sym[at]].sum()
        assert np.abs(gamma[at] - g).max() < 1e-3
        x += e
    assert np.allclose(moves, x, rtol=1e-3)


def test_table_keeps_the_more_frequent_word():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(1, 2**63, 400_000).astype(np.uint64))
    rng.shuffle(h)
    t = hm.Table(h, 200_000)
    assert len(t) == 200_000 and (t.words == h[t.taken]).all() and (np.diff(t.taken) > 0).all()
    at = t.find(h)
    assert (h[t.taken] == h[at >= 0]).all() and (t.words[at[at >= 0]] == h[at >= 0]).all()
    assert (hm.Table(h[:0], 5).find(h) == -1).all()


def test_clusters_follow_co_occurrence():
    x = np.zeros((12, 12))
    for c in range(3):
        x[4 * c:4 * c + 4, 4 * c:4 * c + 4] = 5
    label = hm.clusters(x + 0.1 + np.eye(12), 3)
    assert [len(set(label[4 * c:4 * c + 4])) for c in range(3)] == [1, 1, 1] and len(set(label)) == 3


def two_kinds(spark, n=300):
    rng = np.random.default_rng(6)
    kinds = [[f"{p}{i}" for i in range(40)] for p in "ab"]
    docs = [(i, " ".join(rng.choice(kinds[i % 2], rng.integers(20, 60)))) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_rounds_raise_the_likelihood_and_the_words_are_all_there(spark, monkeypatch):
    """Two vocabularies that never meet; most of their words outside the head."""
    monkeypatch.setattr(hm, "HEAD", 20)
    monkeypatch.setattr(hm, "SEEDS", 12)
    monkeypatch.setattr(hm, "FREQUENT", 30)
    monkeypatch.setattr(hm, "GAIN", -1.0)
    df = two_kinds(spark)
    corpus, m = hm.fit(df, states=2, rounds=4)
    assert len(m.rounds) == 4 and all(b > a - 1e-6 * abs(a) for a, b in zip(m.rounds, m.rounds[1:]))
    rows = m.words.collect()
    assert len(rows) == 80 == corpus.kinds - 1 and m.words.count() == corpus.counts.count()
    emit = np.array([[r.e0, r.e1] for r in rows])
    assert emit.sum(axis=0) + m.end + m.unseen == pytest.approx(1)          # a distribution in each state
    assert m.move.sum(axis=1) == pytest.approx(1) and m.start.sum() == pytest.approx(1)
    of = {int(h): w for w in [f"{p}{i}" for p in "ab" for i in range(40)]
          for h in hm.tokens(pa.array([w]))[0].view(np.int64)}
    side = {(of[r.word][0], bool(r.e0 > r.e1)) for r in rows}
    assert len(side) == 2                                                    # also the words outside the head
    got = hm.score(df, corpus, m).collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert 0.25 < gain < math.log10(2)                                       # half the words remain possible


def test_scores_equal_the_definition(spark, monkeypatch):
    """Each text's score from the table of words, one step at a time."""
    monkeypatch.setattr(hm, "FREQUENT", 5)
    df = two_kinds(spark, 40)
    corpus, m = hm.fit(df.where("doc_id < 30"), states=3, rounds=2)
    emit = {r.word: np.array([r.e0, r.e1, r.e2]) for r in m.words.collect()}
    more = df.union(spark.createDataFrame([(100, "a0 never b1"), (101, None), (102, df.first().text), (103, "b3 " * 2500)], df.schema))
    for r in hm.score(more.withColumn("text2", more.text), corpus, m).collect():
        h = hm.tokens(pa.array([r.text2], pa.string()))[0].view(np.int64).tolist()
        vectors = [emit.get(x, m.unseen) for x in h] + [m.end]
        want, _, _ = naive(range(len(vectors)), hm.Model(m.start, m.move, np.array(vectors)))
        assert r.score == pytest.approx(want / math.log(10), rel=1e-4)


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or "")), None]


def check(docs, train, rows):
    c = Counter(w for i, t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(words(t)), sum(c[w] > 0 for w in words(t)),
                   sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in docs)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in rows)
    assert len(got) == len(want) and all(r.train_tokens == n for r in rows)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-6)
    assert all(math.isfinite(r.score) for r in rows)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(hm, "FREQUENT", 20)
    docs = [(i, "the cat sat on the mat " * (i % 5) + f"only{i} The") for i in range(40)]
    docs += [(100, None), (101, ""), (3, docs[3][1]), (None, "never seen"), (102, "the " * 60_000)]
    df = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], "doc_id long, text string, n_known string, __row string, e0 int")
    train = df.where("doc_id < 30")
    check(docs, [d for d in docs if d[0] is not None and d[0] < 30], hm.score(df, *hm.fit(train, rounds=1)).collect())
    check(docs, [], hm.score(df, *hm.fit(df.limit(0), rounds=1)).collect())
    assert hm.score(df.limit(0), *hm.fit(train, rounds=1)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    rows = QUERIES["op3_hidden_markov"](spark, sf).collect()
    check(docs, [d for d in docs if d[0] not in held], rows)
    assert {r.doc_id for r in rows if r.held_out} == held
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
