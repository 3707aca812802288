"""Token ids of documents as Simple-8b files, in ascending order of ``doc_id``.

``write_token_files`` deals documents out by ranges of ``doc_id`` (sampled splitters),
sorts each range and writes one file for it; ``read_token_files`` reads the files
back. A document is its ids and one end id.

Cases: a null text is an empty one (the end id alone); a null ``doc_id`` is kept and
sorts first; rows with equal ``doc_id`` are each kept, in the order of a hash of their
texts; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import Workspace, batch_bytes
from .simple8b import Reader, Writer
from .wordids import slices, with_end, word_ids


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, ws: Workspace) -> DataFrame:
    """One row per file: part, uri, n_docs, n_tokens, n_bytes. Rows are those of the
    attempts that Spark committed."""
    folder = ws.path("ids")

    def write(batches):
        part = TaskContext.get().partitionId()
        writer, uri = None, None
        encoder = word_ids(vocabulary)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for lo, texts in slices(batch["text"]):
                if writer is None:
                    uri = files.attempt_name(folder, part, ".s8b")
                    writer = Writer(files.open_write(uri))
                flat, counts = with_end(*encoder.encode(texts), end_id)
                writer.add(ids[lo : lo + len(texts)], counts, flat)
        if writer is not None:
            done = writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, **done}])

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    schema = "part long, uri string, n_docs long, n_tokens long, n_bytes long"
    with batch_bytes(ws.spark, "8m"):
        return ws.save(ordered.mapInArrow(write, schema), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, the ids. The manifest has
    a row for each file, so its running total is taken on the driver."""
    rows, base = [], 0
    for r in manifest.orderBy("part").collect():
        rows.append((r.uri, base))
        base += r.n_tokens

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with files.open_read(uri) as source:
                    out: list[tuple] = []
                    size = 0
                    for doc, ids in Reader(source).documents():
                        ids = ids.astype("<u4")
                        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                        start += len(ids)
                        size += len(ids)
                        if size > 1_000_000 or len(out) >= 5000:
                            yield to_batch(out)
                            out, size = [], 0
                    if out:
                        yield to_batch(out)

    def to_batch(out):
        *columns, ids = zip(*out, strict=True)
        columns = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            cuts = np.cumsum([0, *columns[2].to_pylist()]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(ids).astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    found = spark.createDataFrame(rows, "uri string, base long")
    if rows:
        found = found.repartition(len(rows))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return found.mapInArrow(read, schema + ", ids array<long>" * with_ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    ws = Workspace(spark, "token-files")
    manifest = write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, ws
    )
    return read_token_files(spark, manifest, with_ids=False)
