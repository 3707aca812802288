"""Exact deduplication by sorting content.

Rows are dealt out by sampled splitters over the order (leading bytes, SHA-256, text,
id descending), so equal texts come to lie next to each other and a large group is
split between tasks by its ids. Each task sorts its range (Spark's sort spills to
disk) and compares every text in full with the one before it. Only the first and
last run of a task can go on in a neighbour's: their texts are kept, two a task at
most, and grouped by the whole text.

Splitters are sampled on the driver, so they hold no texts: the leading bytes, the
digest and the id tell where a row goes; the sort and the comparison use whole texts.

Cases: a null text equals an empty one; a null id is smaller than any other; of equal
texts with equal ids one row stays; an empty table gives no rows; other columns pass
through ``keepers`` unchanged, whatever their names: the operator's own columns take
names that the table doesn't have.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, column, columns, free_names, table

#: Leading bytes of a text in a splitter; ties are broken by digest and id.
SPLITTER_BYTES = 48


@dataclass
class Runs:
    """Rows in runs of equal texts. ``part`` and ``run`` name the columns of the task and of
    the run's number in it, ``head`` whether the row is the run's first (its largest id), ``sha``
    the text's digest, ``edge`` the text of a task's first and last row, else null."""

    rows: DataFrame
    kept: list[str]
    id_col: str
    part: str
    run: str
    head: str
    sha: str
    edge: str

    def totals(self) -> DataFrame:
        """(task, run) to keep_id, group_size and the first task of the run."""
        key = [column(self.part).alias("part"), column(self.run).alias("run")]
        own = self.rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(column(self.id_col)).alias("id"))
        ends = self.ends(own).withColumnsRenamed({"part": "p", "run": "r"})
        return own.join(F.broadcast(ends), (F.col("part") == F.col("p")) & (F.col("run") == F.col("r")), "left").select(
            "part", "run", F.coalesce("all_id", "id").alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), F.coalesce("all_part", "part").alias("first_part")
        )

    def ends(self, own: DataFrame | None = None) -> DataFrame:
        """The first and last run of each task with the first task of the whole run; and, given
        counts and ids by run, the whole run's. Two rows a task at most."""
        edge = (
            self.rows.where(column(self.edge).isNotNull())
            .groupBy(column(self.part).alias("part"), column(self.run).alias("run"))
            .agg(F.first(column(self.sha)).alias("sha"), F.first(column(self.edge)).alias("text"))
        )
        if own is not None:
            few = own.join(F.broadcast(edge.select("part", "run")), ["part", "run"])
            edge = edge.join(few, ["part", "run"])
        else:
            edge = edge.withColumn("n", F.lit(0).cast("long")).withColumn("id", F.lit(None).cast("long"))
        whole = edge.groupBy(F.col("sha").alias("s"), F.col("text").alias("t")).agg(
            F.sum("n").alias("all_n"), F.max("id").alias("all_id"), F.min("part").alias("all_part")
        )
        return edge.join(whole, (F.col("sha") == F.col("s")) & (F.col("text") == F.col("t"))).select("part", "run", "all_n", "all_id", "all_part")


def sorted_runs(df: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> Runs:
    kept = [c for c in df.columns if keep_text or c != text_col]
    names = free_names(df, "__part", "__run", "__head", "__sha256", "__edge")
    # On the way through the task the table's columns go by their places.
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    text, ident, sent = place[text_col], place[id_col], [place[c] for c in kept]
    own = ["part", "run", "head", "sha", "edge"]
    schema = T.StructType(
        [T.StructField(place[c], df.schema[c].dataType) for c in kept]
        + [T.StructField(n, t) for n, t in zip(own, (T.LongType(), T.LongType(), T.BooleanType(), T.StringType(), T.StringType()), strict=True)]
    )

    def compare(batches):
        task, number, last, last_sha = TaskContext.get().partitionId(), -1, None, None
        held = None  # a batch goes on when the next one shows that it isn't the last
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield finished(*held)
            texts, digests = pc.fill_null(batch[text], ""), batch["sha"]
            # A text begins a run unless it is, in full, the text before it.
            heads = [last is None or digests[0].as_py() != last_sha or texts[0].as_py() != last]
            if n > 1:
                heads += pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_pylist()
            runs = []
            for h in heads:
                number += h
                runs.append(number)
            edges = [None] * n
            if last is None:
                edges[0] = texts[0].as_py()
            last, last_sha = texts[n - 1].as_py(), digests[n - 1].as_py()
            held = (batch, [pa.array([task] * n, pa.int64()), pa.array(runs, pa.int64()), pa.array(heads), digests], edges)
        if held is not None:
            held[2][-1] = last
            yield finished(*held)

    def finished(batch, marks, edges):
        return pa.RecordBatch.from_arrays([batch[c] for c in sent] + marks + [pa.array(edges, pa.string())], [*sent, *own])

    body, by_id = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(ident).desc_nulls_last()
    ordered = (
        df.select(*[column(c).alias(p) for c, p in place.items()])
        .withColumn("lead", F.substring(body.cast("binary"), 1, SPLITTER_BYTES))
        .withColumn("sha", F.sha2(body.cast("binary"), 256))
        .repartitionByRange("lead", "sha", by_id)
        .sortWithinPartitions("lead", "sha", body, by_id)
    )
    marked = ordered.mapInArrow(compare, schema).select(
        *[F.col(place[c]).alias(c) for c in kept], *[F.col(o).alias(n) for o, n in zip(own, names, strict=True)]
    )
    return Runs(ws.save(marked, "runs"), kept, id_col, *names)


def keepers(runs: Runs) -> DataFrame:
    """The row that stays for each text: the head of its run, unless the run only goes on
    from an earlier task."""
    on = runs.ends().where("run = 0 and all_part < part").select(F.col("part").alias(free_names(runs.rows, "__on")[0]))  # a row a task at most
    return (
        runs.rows.where(column(runs.head))
        .join(F.broadcast(on), (column(runs.part) == column(on.columns[0])) & (column(runs.run) == 0), "left_anti")
        .select(*[column(c) for c in runs.kept])
    )


def dedup(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    runs = sorted_runs(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), ws, keep_text=False)
    own = runs.rows.withColumnsRenamed({runs.part: "p", runs.run: "r"})
    return own.join(runs.totals(), (F.col("p") == F.col("part")) & (F.col("r") == F.col("run"))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (column(runs.head) & (F.col("p") == F.col("first_part"))).alias("kept"),
        column(runs.sha).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), Workspace(spark, "exact-dedup"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
