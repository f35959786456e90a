import hashlib
import random

from wavespark.llm import warc
from wavespark.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, payload_bytes string"


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        refers = first.get(raw)
        refers = None if refers == i else refers
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)


def test_round_trip(spark):
    rnd = random.Random(5)
    rows = [(i, f"http://x/{i}\r\ny", "".join(rnd.choices("abc <p>é", k=rnd.randrange(3000))), "z") for i in range(300)]
    rows += [(1000 + i, None, "hot copy " * 40, "z") for i in range(200)]
    rows += [(2000, "u", None, None), (2001, "u", "", None), (2002, "u", "x" * 99, "z"), (2003, "u", "x" * 99, "z"),
             (None, "u", "hot copy " * 40, "z"), (1000, "u", "hot copy " * 40, "z"), (3000, "u", "é" * 400_000, "z"),
             (None, "u", "only nulls " * 30, "z"), (None, "u", "only nulls " * 30, "z")]
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, archive_bytes=100_000)
    back = warc.read_archives(manifest, folder)
    kept = back.collect()
    assert got(kept) == expected(rows)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == text[r.page_id] for r in kept if r.record_type == "response" and r.page_id)
    for r in manifest.collect():
        with open(r.file, "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.SKIPPABLE
    assert sum(r.records for r in manifest.collect()) == len(rows)


def test_empty(spark):
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_archives(manifest, folder).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(QUERIES["op4_warc_dictionary"](spark, sf).collect()) == expected(rows)
