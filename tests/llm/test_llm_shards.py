import zlib
from collections import Counter, defaultdict

import pytest

from wavespark.llm import shards
from wavespark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, shard string, size int"


def loads(rows, n):
    by, slots = Counter(), defaultdict(list)
    for r in rows:
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [by[i] for i in range(n)]


@pytest.mark.parametrize("fine", [1 << 24, 300])
def test_equal_bytes_with_a_hot_text(spark, fine):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 17), "old", 1) for i in range(3000)]
    rows += [(None, None, None, None), (5000, "", "x", 0)]
    got = shards.shard_documents(spark.createDataFrame(rows, SCHEMA), 10, range_bytes=fine * 10).collect()
    assert len(got) == len(rows)
    by = loads(got, 10)
    assert max(by) - min(by) <= 2 * max(r.size for r in got)
    assert {r.doc_id: r.size for r in got if r.doc_id} == {r[0]: len(r[1].encode()) + 16 for r in rows if r[0]}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shards.shard_documents(empty, 4).count() == 0
    few = shards.shard_documents(spark.createDataFrame([(1, "a", "", 0), (1, "a", "", 0), (2, None, "", 0)], SCHEMA), 40)
    rows = few.collect()
    assert len(rows) == 3
    loads(rows, 40)
    long = spark.createDataFrame([(1, "x" * 200_000, "", 0)] + [(i, "y", "", 0) for i in range(2, 50)], SCHEMA)
    loads(shards.shard_documents(long, 4).collect(), 4)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_histogram_sort"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    by = loads(got, 40)
    assert max(by) - min(by) <= 2 * max(r.size for r in got)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
