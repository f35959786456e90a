import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from wavespark.llm import language_id as li
from wavespark.llm.queries import QUERIES

LANGS = {
    "en": "the quick brown fox jumps over the lazy dog and runs with the other animals through this forest",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft mit den anderen tieren durch diesen wald",
    "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει με τα άλλα ζώα",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и бежит с другими животными по лесу",
}


def model(spark):
    rows = [(i, t, l, "x") for i, (l, t) in enumerate(LANGS.items())] + [(9, None, "en", ""), (10, "??", "zz", ""), (11, "abc", None, "")]
    return li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))


def test_code_points():
    s = "aé日\U0001F600ñ z"
    at, cp = li.code_points(np.frombuffer(s.encode(), dtype=np.uint8))
    assert cp.tolist() == list(map(ord, s))
    t = li.analyse(pa.array([s, None, "", "Ω 12 ж"]))
    assert t.letters.tolist() == [4, 1, 1, 0, 1]
    assert all(c[0] == "L" for c in map(unicodedata.category, "aé日ñzΩж"))


def test_viterbi_equals_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        n, k = int(rnd.integers(1, 7)), 3
        s = rnd.normal(size=(n, k)).astype(np.float32) * 3
        got = li.viterbi(s, np.array([0, n]), 2.0)
        paths = np.stack(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1)
        cost = s[np.arange(n)[:, None], paths].sum(axis=0) - 2.0 * (paths[1:] != paths[:-1]).sum(axis=0)
        mine = s[np.arange(n), got].sum() - 2.0 * (got[1:] != got[:-1]).sum()
        assert abs(mine - cost.max()) < 1e-4
    a, b = rnd.normal(size=(5, 2)).astype(np.float32), rnd.normal(size=(9, 2)).astype(np.float32)
    both = li.viterbi(np.vstack([a, b]), np.array([0, 5, 5, 14]))
    assert both.tolist() == li.viterbi(a, np.array([0, 5])).tolist() + li.viterbi(b, np.array([0, 9])).tolist()


def test_scripts_spans_and_edges(spark):
    m = model(spark)
    assert m.langs == ["de", "el", "en", "ru", "zz"]
    mixed = LANGS["en"] + " " + LANGS["ru"] + " ... " + LANGS["el"]
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "собака"), (5, mixed), (6, "hund und wald"), (6, "hund und wald"),
            (7, LANGS["de"] * 3000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang_pred string, spans int")
    got = {r.doc_id: r for r in li.identify(df, m).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["und", "und", "und", "ru", "en", "de", "de"]
    assert [s.lang for s in got[5].spans] == ["en", "ru", "el"]
    assert got[1].spans == [] and got[1].score == 0 and 0 < got[5].score < 1 and got[6].score == 1
    assert li.identify(df.limit(0), m).count() == 0
    nothing = li.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in li.identify(df, nothing, spans=False).collect()} == {"und"}


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_script_viterbi"](spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
