"""WARC archives with dictionary-compressed records.

A file is a skippable frame that holds a Zstandard dictionary, then one Zstandard
frame for each record. The dictionary is built from the first records that go into
the file (at most ``SAMPLE_BYTES`` of them, which also bounds what a task holds). A
payload that another record of the job has is not written again: its record is a
revisit that refers to the response by record id.

``plan`` tells responses from revisits: the largest ``page_id`` of equal payloads is
the response. Payloads are equal if their SHA-256 and length are. Rows are dealt out
by digest and by a salt of the id, so that a payload which a third of the pages share
still goes to many tasks, each of which gets the group's one row.

Cases: a null html is an empty payload; payloads below ``least`` bytes are all
responses; a null url is written without a target; a null ``page_id`` is smaller than
any other and its record has no page header; of equal payloads with equal page_id
each of those rows is a response; an empty table gives no files; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import Workspace, table

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
RECORD_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the table has no date; a fixed one makes files repeatable

SAMPLE_BYTES = 4_000_000
DICTIONARY_BYTES = 110 * 1024
#: A hot digest's rows go to so many groups of tasks.
SALTS = 32


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = payload_digest(payload)
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.translate({10: "%0A", 13: "%0D"}))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:n]


def build_dictionary(sample: list[bytes]):
    """Trained if the sample is large enough to train on, else its last bytes."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, sample, level=3)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Writer:
    def __init__(self, out):
        self.out, self.waiting, self.held, self.compressor = out, [], 0, None
        self.records = self.n_bytes = self.raw_bytes = 0

    def add(self, rec: bytes) -> None:
        self.records += 1
        self.raw_bytes += len(rec)
        if self.compressor is not None:
            self._put(self.compressor.compress(rec))
            return
        self.waiting.append(rec)
        self.held += len(rec)
        if self.held >= SAMPLE_BYTES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _start(self) -> None:
        import zstandard as zstd

        # A record longer than the sample still gives only its beginning to the dictionary.
        words = build_dictionary([r[:SAMPLE_BYTES] for r in self.waiting])
        data = words.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.compressor = zstd.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
        for rec in self.waiting:
            self._put(self.compressor.compress(rec))
        self.waiting = []

    def close(self) -> dict:
        if self.compressor is None:
            self._start()
        self.out.close()
        return {"records": self.records, "n_bytes": self.n_bytes, "raw_bytes": self.raw_bytes}


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Record by record: no more than one and a read buffer is in memory."""
    import zstandard as zstd

    magic, n = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with its dictionary")
    data = source.read(n)
    trained = data[:4] == b"\x37\xa4\x30\xec"  # the magic number of trained dictionaries
    words = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)
    decompressor = zstd.ZstdDecompressor(dict_data=words)
    rest = b""
    while True:
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            rest = rest or source.read(1 << 18)
            if not rest:
                if parts:
                    raise ValueError("the archive is cut off")
                return
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield parse_record(b"".join(parts))


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to."""
    rows = (
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
        .withColumn("sha", F.unhex(F.sha2("payload", 256)))
        .withColumn("size", F.length("payload").cast("long"))
        .withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    )
    first = (
        rows.where(F.col("size") >= least)
        .groupBy("sha", "size")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .drop("n")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, ["sha", "size", "salt"], "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def write_archives(planned: DataFrame, ws: Workspace) -> DataFrame:
    """One row per file: uri, records, n_bytes, raw_bytes, of committed attempts."""
    folder = ws.path("warc")

    def write(batches):
        part = TaskContext.get().partitionId()
        writer, uri = None, None
        for batch in batches:
            columns = [batch[c] for c in ("page_id", "url", "payload", "refers_to", "revisit")]
            for i in range(batch.num_rows):
                if writer is None:
                    uri = files.attempt_name(folder, part, ".warc.zst")
                    writer = Writer(files.open_write(uri))
                writer.add(record(*(c[i].as_py() for c in columns)))
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"uri": uri, **writer.close()}])

    return ws.save(planned.mapInArrow(write, "uri string, records long, n_bytes long, raw_bytes long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of
    each record; a response's digest and length are taken from the payload read."""
    uris = [(r.uri,) for r in manifest.select("uri").collect()]  # a row for each file

    def read(batches):
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                with files.open_read(uri) as source:
                    out: list[dict] = []
                    size = 0
                    for head, body in read_records(source):
                        out.append(row(head, body))
                        size += len(body)
                        if size > 4_000_000 or len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

    def row(head: dict[str, str], body: bytes) -> dict:
        number = lambda name: int(head[name]) if name in head else None
        kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if kind == "response" and (payload_digest(body) != digest or len(body) != size):
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
        return {
            "page_id": number("X-Page-ID"), "url": head.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": body if kind == "response" else None,
        }

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )
    found = spark.createDataFrame(uris, "uri string")
    if uris:
        found = found.repartition(len(uris))
    return found.mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    manifest = write_archives(plan(table(spark, sf_dir, "pages")), ws)
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
         sha1(coalesce(html, '')) AS hex
  FROM pages
)
SELECT page_id,
       strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INTEGER, 5))::BIGINT) >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p
"""
