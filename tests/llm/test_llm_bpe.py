import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavespark.llm import bpe
from wavespark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = ["", " ", "a" * 3000, "it'S 'LL 12<|endoftext|>x<|startoftext|>", "<|", "日本語" * 40, "ΑΣ. İ ß \x1c\x85 é é",
         "thethethe" * 200, "\U000105c3!\U00010d41", "\n\t  \n"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_codec_equals_the_library(reference):
    c = bpe.Codec(PATH)
    rnd = random.Random(3)
    texts = CASES + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x600), rnd.randrange(0x3000, 0xD000)]))
                             for _ in range(rnd.randrange(200))) for _ in range(200)]
    for t in texts:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids
        assert c.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_heap_equals_scan():
    c = bpe.Codec(PATH)
    for w in ("thetheinging" * 3, "a" * 40, "zxqj" * 10):
        ids = [c.inner[b] for b in w.encode()]
        assert c._scan(list(ids)) == c._heap(list(ids))


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(90, None, None), (0, CASES[0], "x"), (None, "tie", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    c = bpe.Codec(PATH)
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == c.encode(r.text) and r.decoded == c.decode(r.ids)
    both = bpe.encode_decode(df, PATH).collect()
    assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in both) == sorted((r.doc_id or -1, r.ids, r.decoded) for r in got)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_query(spark, reference):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
