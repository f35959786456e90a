import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from wavespark.llm import merkle
from wavespark.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, b int, g string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(one(v) for v in r[:5]))


def up(level):
    return [H(*level[i:i + 8]) for i in range(0, len(level), 8)]


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        run = i - i % 8
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + 8])))
        i //= 8
    return out


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(((r[0] is not None, r[0] or 0), leaf(r), r[0]))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(by[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    return sorted((str(x[2]), x[1], trees[g][-1][0], top[-1][0], str(siblings(trees[g], i) + siblings(top, k)))
                  for k, g in enumerate(names) for i, x in enumerate(sorted(by[g])))


def found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(s.left, s.right) for s in r.siblings]))
                  for r in df.collect())


def cases():
    rows = [(i, f"s{i % 7}", "en", i * 3, f"text Ä{i}", "x", 1, "g") for i in range(5000)]  # ten blocks, two heights
    rows += [(i, None, "de", None, "", "x", 1, "g") for i in range(512)]  # one full block
    rows += [(i, "s", "fr", 1, None, "x", 1, "g") for i in range(513)]    # a block of one node
    rows += [(7, "s", None, 1, "alone", "x", 1, "g"), (None, None, "", None, None, "x", 1, "g")]
    rows += [(9, "s", "it", 4, "same", "x", 1, "g")] * 3 + [(9, "s", "it", 4, "other", "x", 1, "g")]
    rows += [(3, "s", "ё", 4, "long " * 100_000, "x", 1, "g"), (4, "s", "Z", 4, "b", "x", 1, "g")]
    return rows + [(i, "s", f"l{i}", 0, "many groups", "x", 1, "g") for i in range(20)]


def test_equals_the_definition(spark):
    rows = cases()
    got = merkle.prove(merkle.build(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert found(got) == brute(rows)


def test_any_change_breaks_the_fold(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA)
    shown = [F.lower(f) if f == "text" else F.col(f) for f in merkle.FIELDS]
    m = merkle.build(docs, presented=shown, where=F.col("doc_id") % 2 == 0)
    got = merkle.prove(m).select("doc_id", "lang", (merkle.folded("presented", "siblings") == F.col("root")).alias("ok")).collect()
    changed = {(r[0], r[2]) for r in rows if r[0] is not None and r[0] % 2 == 0 and r[4] and r[4].lower() != r[4]}
    assert changed
    assert all(r.ok == ((r.doc_id, r.lang) not in changed) for r in got) and len(got) == len(rows)
    assert len(m.subroots().collect()) == len({r[2] for r in rows})
    assert m.root() == brute(rows)[0][3]


def test_empty_and_single(spark):
    empty = merkle.build(spark.createDataFrame([], SCHEMA))
    assert empty.root() is None and merkle.prove(empty).count() == 0
    row = (1, "s", "en", 2, "ab", "x", 1, "g")
    one = merkle.build(spark.createDataFrame([row], SCHEMA))
    assert one.root() == leaf(row)
    assert merkle.prove(one).first().siblings == []
    one.drop()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    want = {r[0]: r for r in brute(rows)}
    for r in QUERIES["op13_merkle_levels"](spark, sf).collect():
        _, node, subroot, root, path = want[str(r.doc_id)]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (node, subroot, root, H(*(a + b for a, b in eval(path))))
        text = next(x[4] for x in rows if x[0] == r.doc_id)
        kept = zlib.crc32(str(r.doc_id).encode()) % 3 or not any("A" <= c <= "Z" for c in text)
        assert r.verified == bool(kept) == (r.folded_root == r.root)
