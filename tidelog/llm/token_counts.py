"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes (insert, delete or revise a document's count under one tokenizer
version) is turned into signed rows: what the store had for the document is taken
off, what the batch says is added. Totals are sums of the signed rows of all committed
batches, so they never need a recount, and a document that moves to another source or
language leaves its old total and joins the new one.

A batch is committed by one rename, under its id. A batch id that is already committed
changes nothing, and what a failed attempt left is never read, so a batch may be sent
again at any time. One writer at a time. Of what the store had, only the rows of the
batch's own documents are looked up; after ``FOLD_AFTER`` batches their ledgers and
deltas are folded into one, which is a commit like another.

Cases: of several changes to a document and version in a batch the one with the
highest ``seq`` counts, of equal ones the last in the order (delete first, then by
count, source, language); an insert of a known document revises it, a revision of an
unknown one inserts it, a deletion of an unknown one does nothing; a null count is 0;
a null source or language is a group of its own; a document without ``doc_id`` can't
be found again: its insert only adds, other changes to it do nothing; other ops than
the three are ignored; totals without documents and tokens aren't shown; other columns
are ignored.
"""

from __future__ import annotations

import json
import uuid
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch_bytes, table
from .wordids import slices, word_ids

KEY, GROUP = ["doc_id", "tokenizer"], ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, batch long"
#: Batches after which ledgers and deltas are folded.
FOLD_AFTER = 16
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def commits(self) -> list[dict]:
        """Committed batches in order; one small file each."""
        folder = self._path("commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        out = []
        for name in names:
            if name.endswith(".json"):
                stream = self._fs.open(self._path(f"commits/{name}"))
                out.append(json.loads(bytes(stream.readAllBytes())))
                stream.close()
        return out

    def _publish(self, entry: dict) -> None:
        temporary = self._path(f"commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        if not self._fs.rename(temporary, self._path(f"commits/{entry['batch']:012d}.json")):
            raise RuntimeError(f"batch {entry['id']} was not committed")

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = self.commits()
        folds = [i for i, c in enumerate(done) if c.get("fold")]
        paths = [f"{self.root}/{c['data']}/{kind}" for c in done[folds[-1] if folds else 0 :]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _now(ledger: DataFrame) -> DataFrame:
        row = F.struct("batch", "alive", "source", "lang", "n_tokens")
        return (
            ledger.groupBy(*KEY).agg(F.max(row).alias("now"))
            .where("now.alive").select(*KEY, "now.source", "now.lang", "now.n_tokens", "now.batch")
        )

    def documents(self) -> DataFrame:
        """The store's present row for each document and version."""
        return self._now(self._read("ledger", LEDGER)).drop("batch")

    def fold(self) -> None:
        """One ledger and one table of deltas in the place of those of all batches."""
        number = 1 + max((c["batch"] for c in self.commits()), default=0)
        data = f"data/{number:012d}-{uuid.uuid4().hex[:12]}"
        present = self._now(self._read("ledger", LEDGER))
        present.select(*KEY, "source", "lang", "n_tokens", F.lit(True).alias("alive"), "batch").write.parquet(f"{self.root}/{data}/ledger")
        self.totals().write.parquet(f"{self.root}/{data}/deltas")
        self._publish({"id": None, "batch": number, "data": data, "fold": True})

    def totals(self) -> DataFrame:
        return (
            self._read("deltas", DELTAS)
            .groupBy(*GROUP)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0 or tokens <> 0")
        )

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """``changes(op, seq, doc_id, source, lang, tokenizer, n_tokens)``. Whether the
        batch was new."""
        done = self.commits()
        if any(c["id"] == batch_id for c in done):
            return False
        number = 1 + max((c["batch"] for c in done), default=0)
        data = f"data/{number:012d}-{uuid.uuid4().hex[:12]}"
        rows = changes.where("op in ('insert', 'delete', 'revise')").select(
            F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang",
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), (F.col("op") != "delete").alias("alive"), F.col("seq").cast("long").alias("seq"),
            (F.col("op") == "insert").alias("new"),
        )
        last = F.max(F.struct("seq", "alive", "n_tokens", "source", "lang")).alias("last")
        (
            rows.where("doc_id is not null").groupBy(*KEY).agg(last)
            .select(*KEY, "last.source", "last.lang", "last.n_tokens", "last.alive", F.lit(number).cast("long").alias("batch"))
            .write.parquet(f"{self.root}/{data}/ledger")
        )
        ledger = self.spark.read.schema(LEDGER).parquet(f"{self.root}/{data}/ledger")
        signed = lambda df, sign: df.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col("n_tokens")).alias("tokens"))
        deltas = signed(ledger.where("alive"), 1).unionByName(signed(rows.where("doc_id is null and new"), 1))
        if done:
            keys = ledger.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
            had = self._read("ledger", LEDGER).join(keys, (F.col("doc_id") == F.col("d")) & F.col("tokenizer").eqNullSafe(F.col("t")), "left_semi")
            before = self._now(had)
            deltas = deltas.unionByName(signed(before, -1))
        (
            deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0 or tokens <> 0").write.parquet(f"{self.root}/{data}/deltas")
        )
        self._publish({"id": batch_id, "batch": number, "data": data})
        since = 1 + sum(1 for _ in takewhile(lambda c: not c.get("fold"), reversed(done)))
        if since >= FOLD_AFTER:
            self.fold()
        return True


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, lang, n_tokens of each row; a null text has no tokens."""

    def run(batches):
        encoder = word_ids(vocabulary)
        for batch in batches:
            n = [np.empty(0, np.int64), *(encoder.encode(texts)[1] for _, texts in slices(batch["text"]))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], batch["lang"], pa.array(np.concatenate(n))], ["doc_id", "source", "lang", "n_tokens"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: their counts under version 1; then the exact
    copies that have a smaller id are deleted; then version 2, which counts the end id
    too, is added, and version 1 revised to hold it. Each batch is sent twice."""
    import public_tokenizers

    ws = Workspace(spark, "token-counts")
    docs = table(spark, sf_dir, "documents")
    with batch_bytes(spark, "8m"):
        counts = ws.save(count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")), "counts")
    rollup = TokenRollup(spark, ws.path("rollup"))
    change = lambda df, op, seq, version: df.select(F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens")
    one, two = "word_bpe_49k/1", "word_bpe_49k/2"
    # Both sides of the join on the digest are written first: then Spark can split a large group of copies.
    digest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("sha"))
    digest = ws.save(digest, "digests")
    first = digest.groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = ws.save(digest.join(ws.save(first, "first"), "sha").where("doc_id > first").select("doc_id"), "copies")
    ended = counts.withColumn("n_tokens", F.col("n_tokens") + 1)
    for batch_id, changes in (
        ("load", change(counts, "insert", 1, one)),
        ("copies", change(counts.join(copies, "doc_id", "left_semi"), "delete", 1, one)),
        (
            "ends",
            change(ended, "insert", 1, two).unionByName(change(ended.join(copies, "doc_id", "left_anti").where("doc_id is not null"), "revise", 1, one)),
        ),
    ):
        rollup.commit(batch_id, changes)
        rollup.commit(batch_id, changes)
    return rollup.totals()
