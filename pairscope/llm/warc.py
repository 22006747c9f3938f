"""WARC archives, index first.

Writing appends gzip-member records to one archive per task and emits one index row per record: file, offset, length,
url, digest.  Reading selects index rows, sorts them by file and offset, coalesces neighbours into one byte range and
parses the records from there.

Archives and the index lie under one folder that every executor reaches (any file system pyarrow knows).  A retried task
writes under another name and only the rows of finished tasks enter the index, so a lost executor leaves at most an
unreferenced file.

The digests that several rows share are a table of their own, so a payload of a third of all rows is dealt to many tasks
when pages meet it.

Defined cases: a null payload is empty; a null url is the empty string; blanks, controls and other characters up to the
blank are percent-escaped in the record's target URI and read back so, the index keeps the url as given; rows that repeat
an id and a payload are all responses where that id is the smallest; a row without an id revisits the smallest id of its
payload; an empty table gives an empty index; only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_root, small_batches, stored

INDEX_SCHEMA = "id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
READ_SCHEMA = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
DATE = b"1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(uri: str):
    """(file system, path) of a folder named by URI or by local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def name_of(record: int | None) -> bytes:
    return b"" if record is None else b"<urn:record:%d>" % record


def record(ident: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the original's HTTP head only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + name_of(ident),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url).encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
    ]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + name_of(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parsed(member: bytes) -> dict:
    """The fields of one record; a response's digest is taken anew from its payload and must equal its header's."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    number = lambda x: int(x[12:-1]) if x else None
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    revisit, digest = fields[b"WARC-Type"] == b"revisit", fields[b"WARC-Payload-Digest"][5:].decode()
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields[b'WARC-Record-ID']!r}")
    return {
        "id": number(fields[b"WARC-Record-ID"]), "url": fields[b"WARC-Target-URI"].decode(), "record_type": fields[b"WARC-Type"].decode(),
        "refers_to": number(fields.get(b"WARC-Refers-To", b"")), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


def shared_payloads(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(sha, size, first, n) of payloads held by several rows; first is the smallest id.

    Only (id, digest, size) is grouped, by partial minima; digests are computed where the payloads are read."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    firsts = (
        keyed.where(F.col("size") >= min_bytes)
        .groupBy("sha", "size")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return firsts


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Write one record per row under folder and return the stored index (INDEX_SCHEMA)."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = (folder or f"{shared_root(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size")
    )
    firsts = stored(shared_payloads(pages, id_col, payload_col, min_bytes).select("sha", "size", "first"), "shared-payloads")
    rows = rows.join(firsts.hint("shuffle_hash"), ["sha", "size"], "left").select(
        "id", "url", "payload", F.when(F.col("first") < F.coalesce("id", F.lit(2**63 - 1)), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path + "/archives", recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                index = []
                for ident, url, body, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))):
                    if out is None:
                        name = f"archives/{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    digest = base32_sha1(body)
                    member = record(ident, url, body, digest, refers)
                    out.write(member)
                    index.append((ident, url, name, at, len(member), len(body), digest, "response" if refers is None else "revisit", refers))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), INDEX_ARROW.types)], schema=INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    discard(firsts)
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    index._folder = folder
    return index


INDEX_ARROW = pa.schema(
    [("id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
READ_ARROW = pa.schema(
    [("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def read_records(selected: DataFrame, folder: str, gap: int = 64 << 10, span: int = 4 << 20) -> DataFrame:
    """The records (READ_SCHEMA) of selected index rows.

    Rows are range-sorted by file and offset into as many partitions as there are spans of 16 in the selected records, the
    session's shuffle partitions at least, so the archives' bytes decide and not the small index rows; ranges less than
    gap bytes apart are read at once up to span bytes.  No task holds more than one range."""
    rows = selected.select("file", "offset", "length")
    total = rows.agg(F.sum("length").alias("n")).first()["n"] or 0
    n = max(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (16 * span)))
    dealt = rows.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)

        def fetched(ranges: list[tuple[int, int]], name: str):
            begin, end = ranges[0][0], max(o + n for o, n in ranges)
            handle = opened.get(name)
            if handle is None:
                for old in opened.values():
                    old.close()
                opened.clear()
                handle = opened[name] = fs.open_input_file(f"{path}/{name}")
            data = handle.read_at(end - begin, begin)
            rows = [parsed(data[o - begin : o - begin + n]) for o, n in ranges]
            return pa.RecordBatch.from_pylist(rows, schema=READ_ARROW)

        opened: dict = {}
        name, ranges = None, []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if ranges and (file != name or offset > ranges[-1][0] + ranges[-1][1] + gap or offset + length - ranges[0][0] > span):
                    yield fetched(ranges, name)
                    ranges = []
                name = file
                ranges.append((offset, length))
        if ranges:
            yield fetched(ranges, name)
        for old in opened.values():
            old.close()

    return dealt.mapInArrow(read, READ_SCHEMA)
