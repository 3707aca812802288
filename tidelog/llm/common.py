"""What the training-data operators share: folders that every executor sees,
written intermediates, and connected components over links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without it
    (a test) gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # without a scheme, it's in the default file system
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


@contextmanager
def batch_bytes(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of about so many bytes for what is run inside: long texts come to
    the Python workers in smaller lots."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """A folder of one operator call under the shared root.

    Intermediates are written as Parquet and read again, which cuts the lineage
    and survives lost executors. ``drop`` removes one as soon as it's not needed, or all
    of the call's; what a result still reads stays until the caller drops it or the
    shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidelog/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(conf).delete(path, True)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names like these that the table doesn't have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its name as it is, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


#: Parts that one node's links are dealt into.
SALTS = 64


def with_least(links: DataFrame) -> DataFrame:
    """``links(a, b)`` with ``m``, the least ``b`` of each ``a``. A node's links are dealt into
    parts by ``b``; the least of all goes to each part that there is, so a hub's links are never
    brought together."""
    dealt = links.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(parts.select("a", "part").join(least, "a"), ["a", "part"]).select("a", "b", "m")


def connected_components(ws: Workspace, links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``, the smallest node reachable; nodes
    without a link are absent. Null ends and self-links are ignored.

    Every round, each node hands its smallest known neighbour to its larger ones
    and then to its smaller ones, so paths halve and a component becomes a star
    round its least node after about log(diameter) rounds. Each round ends in a
    written table.
    """
    edges = ws.save(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges-0",
    )
    for k in range(rounds):
        # Large star: every neighbour above the node is linked to the least of all.
        both = with_least(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        # Small star: the neighbours below the node, and the node, to the least of them.
        low = with_least(large)
        small = (
            low.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.where("b = m").select("a", "b"))
            .distinct()
        )
        new = ws.save(small, f"edges-{k + 1}")
        ws.drop(f"edges-{k}")
        # A star forest: no node is both an upper and a lower end, or the upper one twice.
        ends = new.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            new.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
