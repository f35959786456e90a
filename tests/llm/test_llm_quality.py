import numpy as np
import pyarrow as pa

from wavespark.llm import quality as q
from wavespark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, keep string"


def docs(n=400):
    """Good prose from sources a and b, junk from source c; some labelled."""
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for i in range(n):
        junk = i % 3 == 0
        w = rng.choice(["the", "river", "runs", "by", "old", "stones", "and", "trees"], 40)
        t = " ".join(f"{x}$$$" if junk else x for x in w) + ("" if junk else ".\nThe end of it.")
        rows.append((i, t, "c" if junk else "ab"[i % 2], "en", len(t), "x"))
        truth[i] = not junk
    return rows, truth


def test_features_equal_plain_counts():
    texts = ["The THE cat\n\n$$ 12 the", "", None, "é é é ñ"]
    x = q.features(pa.array(texts), ["a", None, "a", "b"], ["en"] * 4, [1, None, 3, 4])
    assert x.shape == (4, q.N_ALL) and np.isfinite(x).all()
    # bytes: upper, digit, blank, sentence, sign, beyond
    n = len(texts[0])
    assert np.allclose(x[0, :7] * n, [9, 4, 2, 6, 0, 2, 0][:0] or [sum(c.islower() for c in texts[0]), 4, 2, 6, 0, 2, 0], atol=1e-4)
    assert np.isclose(x[0, 7 + 1] * 6, 1)          # THE is all capitals; $$ and 12 have no letters
    assert np.isclose(x[0, 7 + 5] * 6, 4)          # the, cat, $$, 12
    assert np.isclose(x[3, 7 + 4] * 4, 2)          # é repeats twice
    assert (x[1] == x[2])[:q.N_TEXT].all()
    alone = np.vstack([q.features(pa.array([t], pa.string()), [s], ["en"], [c])
                       for t, s, c in zip(texts, ["a", None, "a", "b"], [1, None, 3, 4])])
    assert np.allclose(x, alone, atol=1e-6)


def test_learns_from_few_labels(spark):
    rows, truth = docs()
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(truth[i]), None) for i in range(0, 400, 4)] + [(1, None, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = q.fit(df, labels)
    out = q.classify(df, model)
    assert out.columns == ["doc_id", "text", "source", "lang", "n_chars", "text_score", "meta_score", "score", "keep"]
    got = {r.doc_id: r for r in out.collect()}
    assert sum(got[i].keep == truth[i] for i in truth) > 0.98 * len(truth)
    assert all(0 <= v <= 1 for r in got.values() for v in (r.text_score, r.meta_score, r.score))


def test_a_view_cannot_teach_what_it_cannot_see(spark):
    """Rare junk that metadata does not show stays recognised by the text."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1500):
        junk = i % 10 == 0
        w = rng.choice(["the", "river", "runs", "by", "old", "stones"], 40)
        t = (" | " if junk else " ").join(w) + "\nThe end of it."
        rows.append((i, t, "ab"[i % 2], "en", 200, "x"))
        if i % 40 in (0, 1, 2, 3):
            labels.append((i, int(not junk)))
    df = spark.createDataFrame(rows, SCHEMA)
    got = q.classify(df, q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    assert all(r.keep == (r.doc_id % 10 != 0) for r in got)


def test_edges(spark):
    rows, _ = docs(60)
    odd = [(900, None, None, None, None, None), (901, "", "a", None, 0, "x"), (1, rows[1][1], "b", "en", 5, "x"),
           (None, "x " * 100_000, "a", "en", None, "x")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.keep) for r in q.classify(df, q.fit(df, none)).collect()} == {(1.0, True)}
    bad = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")
    assert {r.keep for r in q.classify(df, q.fit(df, bad)).collect()} == {False}
    both = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(60)] + [(1, 0)], "doc_id long, quality int")
    model = q.fit(df, both)
    assert q.classify(df, model).count() == len(rows) + len(odd)
    assert q.classify(df.limit(0), model).count() == 0
    assert q.classify(df.select("doc_id", "text"), model).count() == len(rows) + len(odd)


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_cotraining"](spark, sf).collect()}
    assert len(got) == 1000
    right = sum(got[i].keep == bool(v) for i, v in label.items())
    assert right > 0.95 * len(label)
    assert np.mean([got[i].keep for i, v in label.items() if v]) > 0.97
