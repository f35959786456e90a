"""Dictionary-compressed WARC archives (.warc.zst).

Every archive trains a Zstandard dictionary from the records it is about to
hold, carries it in a leading skippable frame (magic 0x184D2A5D), and holds
every record in a frame of its own compressed with it.  Payloads of at least
``MIN_SHARED`` bytes are stored once: the smallest id of equal payloads is a
``response``, the others are ``revisit`` records with headers only.

Tasks write archives of bounded size under names of their own attempt; the
manifest, committed by Spark, names the archives of successful attempts only,
so a lost or repeated task leaves nothing that a reader would count twice.

Rows: a null payload is empty; a null id is written as ``null`` and never
stands for others; rows that repeat the smallest id are responses; null or
odd URLs lose their control characters (a null one has no header); an empty
table gives an empty manifest; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import saved

MIN_SHARED = 100
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 64 << 10
LEVEL = 3
#: Fixed values of the WARC 1.1 and Zstandard dictionary conventions.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, raw_bytes long, file_bytes long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, "
           "payload_bytes long, payload_digest string, payload binary")


def _id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    s = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if s == "null" else int(s)


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One WARC record: a response, or a revisit when ``refers_to`` is set."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id)),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if url:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the records; too few of them make a raw-content one."""
    total = sum(map(len, records))
    try:
        if total < 8 * 1024:
            raise zstandard.ZstdError("little to learn from")
        return zstandard.train_dictionary(min(DICT_BYTES, total // 8), records, k=512, d=8, f=18, accel=4)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(r[:2048] for r in records[:8])[:DICT_BYTES],
                                             dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], date: str) -> bytes:
    d = train(records)
    info = b"software: wavespark\r\nformat: WARC File Format 1.1\r\n"
    head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n"
            f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n").encode()
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)
    raw = d.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw,
                     *(c.compress(r) for r in (head + info + b"\r\n\r\n", *records))])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to (null: response)."""
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    p = pages.withColumn("payload_bytes", F.octet_length(raw).cast("long")).withColumn(
        "payload_digest", F.sha2(raw, 256))
    big = F.col("payload_bytes") >= MIN_SHARED
    first = p.where(big).groupBy("payload_digest").agg(
        F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null")
    # small payloads never match; a key of their own spreads them over the tasks
    p = p.withColumn("__key", F.when(big, F.col("payload_digest")).otherwise(
        F.concat(F.lit("-"), F.xxhash64(key, "payload_digest").cast("string"))))
    first = first.select(F.col("payload_digest").alias("__key"), "__first")
    same = F.col(key).eqNullSafe(F.col("__first"))
    return p.join(first, "__key", "left").withColumn(
        "refers_to", F.when(~same, F.col("__first"))).drop("__key", "__first")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all rows below ``path`` (a shared folder) and return the manifest."""
    cols = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(payload).alias("payload"))
    rows = mark_revisits(cols, "page_id", "payload").select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "payload_bytes", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(path)
        ctx = TaskContext.get()
        name = f"{base}/{ctx.partitionId():06d}-{ctx.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        buffer, size, made = [], 0, 0

        def flush():
            data = archive(buffer, date)
            file = f"{name}-{made:04d}.warc.zst"
            with store.open_output_stream(file, compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([len(buffer)], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([len(data)], pa.int64())], ["file", "records", "raw_bytes", "file_bytes"])

        for b in batches:
            names = ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = part.column("payload").cast(pa.binary()).to_pylist()
                for i, u, h, n, r, raw in zip(*(part.column(c).to_pylist() for c in names if c != "payload"), text):
                    buffer.append(record(i, u, raw or b"", h, n, r, date))
                    size += len(buffer[-1])
                    if size >= archive_bytes:
                        yield flush()
                        buffer, size, made = [], 0, made + 1
        if buffer:
            yield flush()

    return saved(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def frames(data: bytes) -> Iterator[bytes]:
    """Contents of the frames of one archive, in order."""
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError(f"not a dictionary archive: it begins with {magic:#x}")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + n]))
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        one, out = d.decompressobj(), []
        while not one.eof:
            step = view[at:at + 8192]
            if not step:
                raise ValueError("an archive ends within a frame")
            out.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def read_archives(manifest: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records of a manifest's archives.  Digest and size of a response
    are computed from its payload and must equal its header's; those of a
    revisit come from its headers."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(path)
        for b in batches:
            for file in b.column("file").to_pylist():
                with store.open_input_stream(file, compression=None) as f:
                    data = f.read()
                rows = []
                for raw in frames(data):
                    h, block = parse(raw)
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    said = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(said["Content-Length"])
                    kept = h["WARC-Type"] == "response"
                    if kept and (len(body), hashlib.sha256(body).hexdigest()) != (size, digest):
                        raise ValueError(f"damaged record {h['WARC-Record-ID']} in {file}")
                    refers = h.get("WARC-Refers-To")
                    rows.append((_page(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"],
                                 refers and _page(refers), size, digest, body if payload and kept else None))
                for at in range(0, len(rows), 512):
                    cols = zip(*rows[at:at + 512])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    files = manifest.select("file").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInArrow(run, RECORDS)


def archive_folder(spark) -> str:
    """A fresh folder for archives under the shared checkpoint folder; tasks
    create nothing elsewhere."""
    path = scratch_path(spark, "warc")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path
