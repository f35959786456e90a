import random
import re

import numpy as np
import pytest
import xxhash

from wavespark.llm import simhash
from wavespark.llm.components import connected_components
from wavespark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, entry string, node int, least long"


def bits_of(text):
    """The contract's fingerprint, one shingle at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    s = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, min(len(w), 1)))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, distance=3):
    """Smallest index reachable by links, from all pairs."""
    p = np.array(prints, dtype=np.uint64)
    label = np.arange(len(p))
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= distance
    while True:
        new = np.where(near, label[None, :], len(p)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def clouds(rng, n):
    """Random fingerprints, clouds around some, and chains of single bits."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        x = rng.getrandbits(64)
        out += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(n // 6)]
        out += [x ^ (((1 << rng.randrange(33)) - 1) << rng.randrange(32)) for _ in range(20)]
        for _ in range(30):
            out.append(x)
            for _ in range(rng.randint(2, 5)):
                x ^= 1 << rng.randrange(64)
    return sorted(set(out) | {0, 2**64 - 1, 1 << 63, 7})


@pytest.mark.parametrize("distance", range(0, 6))
def test_segments_leave_one_with_a_single_bit(distance):
    parts = simhash.segments(distance)
    assert sum(size for _, size in parts) == 64 and len(parts) == distance // 2 + 1
    assert 2 * len(parts) > distance  # two bits in every segment would be too many


@pytest.mark.parametrize("distance, bucket", [(3, 1024), (3, 16), (3, 2), (2, 8), (1, 1024), (5, 64), (0, 4)])
def test_links_equal_all_pairs(spark, distance, bucket):
    prints = clouds(random.Random(distance * 100 + bucket), 400)
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "entry long")
    found = simhash.links(frame, distance, bucket)
    rows = [(r.a % 2**64, r.b % 2**64) for r in found.collect()]
    got = {r.node % 2**64: r.root % 2**64 for r in connected_components(found).collect()} if rows else {}
    want = components(prints, distance)
    by_root = {}
    for x, label in zip(prints, want):
        assert by_root.setdefault(got.get(x, x), label) == label
    assert len(by_root) == len(set(want.tolist()))


def test_one_bucket_gives_links_not_pairs(spark):
    x = 0x0123456789ABCDEF
    near = sorted({x ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)})
    found = simhash.links(spark.createDataFrame([(v,) for v in near if v < 2**63], "entry long"), 3, 64).count()
    assert found < 200 * len(near)  # at most one for each entry, index row and block


def corpus():
    rng = random.Random(5)
    word = [f"w{i}" for i in range(500)]
    out = [None, "", " \n ", "One", "one", "two words", "TWO  WORDS", "a b c", "ÄÖ é x", "äö é x", "x " * 70_000]
    for _ in range(60):
        w = [rng.choice(word) for _ in range(rng.randint(80, 300))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = "edited"
            out.append("\t".join(v).upper())
    return out


def test_documents(spark):
    texts = corpus()
    rows = [(100 + i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(5, texts[20], "x", 1, 2), (None, texts[30], "x", 1, 2),
                                                                  (101, "", "y", 0, 0), (101, "", "y", 0, 0)]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id)
                 for r in simhash.link_documents(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    prints = [bits_of(r[1]) for r in rows]
    label = components(prints)
    least = {k: min(r[0] for r, m in zip(rows, label) if m == k and r[0] is not None) for k in set(label.tolist())}
    assert got == sorted((str(r[0]), f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, label))
    assert len(set(label.tolist())) < len(set(prints)) < len(rows)


def test_edges(spark):
    assert simhash.link_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = simhash.link_documents(spark.createDataFrame([(None, "a b c d", "", 0, 0)], SCHEMA)).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]
    wide = simhash.fingerprint(spark.createDataFrame([(1, "a b c", "old", 7, 8)], SCHEMA), out="entry").first()
    assert wide.node == 7 and wide.entry % 2**64 == bits_of("a b c")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [bits_of(r.text) for r in docs]
    label = components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op11_deletion_variants"](spark, sf).collect()}
    assert got == {r.doc_id: (f"{p:016x}", docs[k].doc_id) for r, p, k in zip(docs, prints, label)}
