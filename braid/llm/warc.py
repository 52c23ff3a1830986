"""WARC archives compressed by record under a dictionary of their own, and their reader.

An archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from the archive's own records, then one frame for each
record. Any reader of that layout can take a record alone, or all of them in order.

A task buffers records up to ``archive_bytes`` of payload, trains the dictionary on
records spread evenly over the buffer, and writes one file, through the file system that
the URI names, to a name no other attempt uses. Only the manifest rows of successful
tasks are kept, so files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import fresh_path, written

MAGIC = b"\x5d\x2a\x4d\x18"
ARCHIVE_BYTES = 48 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page}/{payload_digest}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def record(page: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of another page's."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page, sha),
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(uri or ""),
        "WARC-Payload-Digest": f"sha1:{sha}",
        "X-Page-Id": "" if page is None else str(page),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, sha), "X-Refers-To-Page-Id": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A Zstandard dictionary from records spread evenly over ``records``, of at most SAMPLE_BYTES."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few records to train on: their own text is the dictionary
        raw = b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes], level: int = 3) -> None:
    import zstandard

    known = dictionary(records)
    raw = known.as_bytes()
    out.write(MAGIC + len(raw).to_bytes(4, "little") + raw)
    packer = zstandard.ZstdCompressor(level=level, dict_data=known)
    for r in records:
        out.write(packer.compress(r))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record; a revisit has no payload of its own."""
    import zstandard

    if source.read(4) != MAGIC:
        raise ValueError("no dictionary frame")
    known = zstandard.ZstdCompressionDict(source.read(int.from_bytes(source.read(4), "little")))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(source, read_across_frames=True, closefd=False), 1 << 18)
    while stream.readline():
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            head[key.decode()] = value.strip().decode()
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block.partition(b"\r\n\r\n")[2]


def _open(uri: str, mode: str):
    """A file of any store that pyarrow knows by its URI (local, HDFS, S3, GCS ...)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_stream(path, compression=None)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def _write(folder: str, archive_bytes: int, level: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            at = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            with _open(at, "w") as out:
                write_archive(out, held, level)
            row = pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(held)])], ["archive", "records"])
            held.clear()
            return row

        size = 0
        for batch in batches:
            for page, uri, html, refers_to in zip(*batch.columns, strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                other = refers_to.as_py()
                held.append(record(page.as_py(), uri.as_py(), payload, other, other is not None))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return work


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for at in batch.column(0).to_pylist():
            rows, size = [], 0
            with _open(at, "r") as source:
                for head, payload in read_archive(source):
                    kind, sha, length = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind == "response" and (digest(payload) != sha or len(payload) != length):
                        raise ValueError(f"a record of {at} is damaged")
                    number = lambda k: int(head[k]) if head.get(k) else None
                    rows.append((number("X-Page-Id"), head["WARC-Target-URI"], payload if kind == "response" else None, length, sha, kind, number("X-Refers-To-Page-Id")))
                    size += len(payload)
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write ``pages`` as archives under ``folder`` (a URI; by default in the shared folder) and return their manifest (archive, records).

    Of records with equal payloads of at least ``least_revisit`` bytes, that with the
    largest id is a response and those with smaller ids revisit it; equal largest ids
    are all responses. A null payload is empty; a null id is below all others, and if a
    payload has null ids only, all are responses. A null URI is empty. Other columns are
    not archived. No rows, no archives.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    flat = pages.select(F.col(id_col).cast("long").alias("page"), F.col(uri_col).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8").alias("payload"))
    marked = flat.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    last = marked.where(F.length("payload") >= least_revisit).groupBy("sha").agg(F.max("page").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    last = written(last, "warc-repeated")  # Spark splits the join of a hot payload only between plain shuffles
    linked = marked.join(last, "sha", "left").withColumn("refers_to", F.when(~F.col("page").eqNullSafe(F.col("last")), F.col("last")))
    return written(linked.select("page", "uri", "payload", "refers_to").mapInArrow(_write(folder, archive_bytes, level), "archive string, records long"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record of the manifest's archives.

    A revisit's payload is null; its length and digest are those of the full payload.
    Responses are held against their digests.
    """
    archives = manifest.select("archive")
    n = max(1, archives.count())
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.repartition(n).mapInArrow(_read, schema)
