import random
import re

import numpy as np
import pyarrow as pa

from wavespark.llm import groups, paragraphs as pg
from wavespark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, removed string, n_words int"
VOCAB = [f"v{i}" for i in range(3000)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))


def brute_lines(rows):
    """Lines to remove: all pairs of long lines by exact Jaccard."""
    lines = [(d, i, frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)))
             for d, t in rows for i, l in enumerate((t or "").split("\n")) for w in [words(l)] if len(w) >= pg.MIN_WORDS]
    up = list(range(len(lines)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a][2], lines[b][2]
            if len(x & y) * pg.DEN >= pg.NUM * len(x | y):
                up[max(top(a), top(b))] = min(top(a), top(b))
    first = {}
    for i, (d, at, _) in enumerate(lines):
        first[top(i)] = min(first.get(top(i), (d, at)), (d, at))
    return {(d, at) for i, (d, at, _) in enumerate(lines) if first[top(i)] != (d, at)}


def test_tune():
    assert 1 - (1 - 0.8**pg.ROWS)**pg.BANDS >= pg.RECALL > 1 - (1 - 0.8**pg.ROWS)**(pg.BANDS - 1)


def test_winnowing_guarantee():
    rnd = random.Random(3)
    for _ in range(60):
        shared = rnd.choices(VOCAB, k=2 * pg.WINDOW - 1)
        texts = [" ".join(rnd.choices(VOCAB, k=rnd.randrange(90)) + shared + rnd.choices(VOCAB, k=rnd.randrange(90))) for _ in range(2)]
        *_, first, h = pg._analyse(pa.array(texts))
        own, pos, fp, _ = pg.winnow(h, first)
        assert set(fp[own == 0]) & set(fp[own == 1])
        alone = pg.winnow(h[first[1]:], first[1:] - first[1])
        assert alone[1].tolist() == pos[own == 1].tolist() and alone[2].tolist() == fp[own == 1].tolist()


def test_repetitive_text_is_one_entry(spark, monkeypatch):
    texts = ["a " * 60, "x y " * 300, "a " * 500, "a " * 200]
    *_, first, h = pg._analyse(pa.array(texts))
    own, pos, fp, reach = pg.winnow(h, first)
    assert np.bincount(own).max() <= 3 and (reach[own == 2].sum() > 400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in pg.dedup(df).collect()}
    assert got == {0: 0, 1: 0, 2: 500, 3: 200}  # equal sets of shingles: the first stays
    mixed = spark.createDataFrame([(i, f"w{i} q{i} z{i} " + t + f" e{i} f{i}") for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(pg, "MIN_WORDS", 10**6)
    got = {r.doc_id: r.n_removed for r in pg.dedup(mixed).collect()}
    assert got == {0: 60, 1: 0, 2: 0, 3: 200}  # within lines the longest stretch stays


def test_cut():
    def go(t, gone):
        b = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = pg.word_spans(b, np.array([0, len(b)]))
        return pg.cut(t.encode(), s, e, np.array([i in gone for i in range(len(s))]))
    assert go("a b c d", {1, 2}) == "a d"
    assert go("a b\nc d\ne", {2, 3}) == "a b\ne"
    assert go(" a b\nc", {0}) == " b\nc"
    assert go("a b\nc d", {1, 2}) == "a\nd"
    assert go("a b c\n", {2}) == "a b\n"
    assert go("é ü\n", {0, 1}) == ""


def test_lines_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(pg, "MIN_RUN", 10**6)
    rnd = random.Random(7)
    bases = [rnd.choices(VOCAB, k=rnd.choice([10, 25, 30, 60, 120])) for _ in range(15)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randrange(5)):
            w = list(rnd.choice(bases)) if rnd.random() < 0.6 else rnd.choices(VOCAB, k=40)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
            lines.append(" ".join(w))
        rows.append((d * 31 % 101, "\n".join(lines)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    gone = brute_lines(rows)
    got = {r.doc_id: r for r in pg.dedup(df).collect()}
    for d, t in rows:
        kept = [l for i, l in enumerate(t.split("\n")) if (d, i) not in gone]
        assert words(got[d].text) == words("\n".join(kept))
        assert got[d].n_words == len(words(t)) and got[d].n_removed == len(words(t)) - len(words(got[d].text))


def test_embedded_passages_and_clean_documents(spark):
    rnd = random.Random(11)
    passages = [rnd.choices(VOCAB, k=n) for n in (51, 60, 90, 200, 40)]
    rows, want = [], {}
    for d in range(80):
        body = rnd.choices(VOCAB, k=rnd.randrange(5, 150))
        k = d % 8
        first = d < 8
        if k < 5:
            at = rnd.randrange(len(body) + 1)
            full = body[:at] + passages[k] + body[at:]
            want[d] = full if first or k == 4 else body
            body = full
        else:
            want[d] = body
        t = " ".join(body)
        rows.append((d, t.replace(" ", "\n", 3) if d % 3 == 0 else t))
    rows += [(900, rows[20][1]), (901, None), (902, ""), (903, "x " * 90_000), (904, "short line"), (905, "short line")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(3, rows[3][1], "x", 1), (None, "only null here", "x", 1)], SCHEMA)
    got = {}
    for r in pg.dedup(df).collect():
        got[r.doc_id] = r
    for d, w in want.items():
        extra = len(words(got[d].text)) - len(w)
        assert words(got[d].text) == w or abs(extra) <= 2 and got[d].n_removed  # chance equal words at an end
    assert len(words(got[900].text)) < 50 and got[901].text is None and got[902].text == ""
    assert got[903].text == "x " * 90_000 and got[905].text == "short line" and got[None].text == "only null here"
    assert got[3].text == rows[3][1]
    assert pg.dedup(df.limit(0)).count() == 0


def test_runs_of_every_earlier_holder(spark):
    """Variants of a passage come first; a run that only a later holder has is found."""
    rnd = random.Random(13)
    rows = []
    for k in range(60):
        passage = rnd.choices(VOCAB, k=rnd.randrange(50, 90))
        for j in range(4):
            p = list(passage)
            if j < 2:
                p[rnd.randrange(len(p))] = f"edit{k}x{j}"
            rows.append((j * 1000 + k, " ".join(rnd.choices(VOCAB, k=rnd.randrange(40, 90)) + p + rnd.choices(VOCAB, k=rnd.randrange(40, 90)))))
    got = {r.doc_id: r for r in pg.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, cuts = set(), 0
    for d, t in sorted(rows):
        w = words(t)
        mine = [tuple(w[i:i + pg.MIN_RUN]) for i in range(len(w) - pg.MIN_RUN + 1)]
        gone = {i + j for i, m in enumerate(mine) if m in seen for j in range(pg.MIN_RUN)}
        seen.update(mine)
        assert words(got[d].text) == [x for i, x in enumerate(w) if i not in gone], d
        cuts += d >= 2000 and bool(gone)
    assert cuts >= 60


def test_the_longest_stretch_stays_whole(spark):
    rnd = random.Random(14)
    lead, tail, *around = (rnd.choices(VOCAB, k=k) for k in (40, 40, 100, 100, 100, 100))
    texts = [around[i] + lead + ["a"] * n + tail + around[i + 2] for i, n in enumerate((55, 60))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    left = {r.doc_id: words(r.text) for r in pg.dedup(df).collect()}
    assert left == {0: around[0] + lead + tail + around[2], 1: around[1] + ["a"] * 60 + around[3]}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_paragraph_bands"](spark, sf).collect()}
    assert sorted(got) == sorted(rows)
    for d, at in brute_lines(sorted(rows.items())):
        line = rows[d].split("\n")[at]
        assert line not in got[d].text.split("\n")
    seen = {}
    for d in sorted(rows):
        w = words(got[d].text)
        mine = {tuple(w[i:i + pg.MIN_RUN]) for i in range(len(w) - pg.MIN_RUN + 1)}
        for m in mine:
            assert seen.setdefault(m, d) == d
