"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are taken together first. The distinct ones are dealt into tiles,
each of one population count (the number of set bits): two fingerprints that differ
in at most r bits have population counts at most r apart, so only tiles that near are
paired; the rest are skipped unread. A pair of tiles is compared in full with numpy
exclusive-or and bit counts and sends out one link for each fingerprint that it joins
to another, not every pair.

The number of tile pairs grows with the square of the number of distinct
fingerprints; nothing is sampled, so the result is exact. Tiles grow with the square
root of their number, which keeps what is sent between tasks in step with the
comparisons made.

Cases: a null or empty text, or one without words, has fingerprint zero and links like
any other; a text of fewer than ``k`` words is one shingle; repeated shingles count
each time; rows with equal or null ``doc_id`` are kept apart, a null being larger than
any other; an empty table gives no rows; other columns are ignored or, in
``one_of_each``, passed on, whatever their names: the operator's own columns take names
that the table doesn't have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, column, columns, connected_components, free_names, table
from .numpy_links import Blocks

#: Fingerprints in a tile, at least; and tiles at which tiles begin to grow.
TILE_ROWS, TILES = 8192, 128
SIDE = 1 << 10  # fingerprints compared at once: the block stays in the cache


def fingerprint(text: bytes | None, k: int = 4, seed: int = 42) -> int:
    """A bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(b" ".join(words), seed)
    # Shingles are cut out of the joined words: no joining for each.
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    lo = [0, *ends[: len(words) - k].tolist()]
    hi = (ends[k - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(lo, hi, strict=True)], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, name: str = "__fp") -> DataFrame:
    """The rows of ``docs`` with the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, k) for t in s], "u8").view("i8"))

    return docs.withColumn(name, fp(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))


def near_links(fps: DataFrame, ws: Workspace, radius: int = 4) -> DataFrame:
    """Links (a, b) that join the distinct ``__fp`` of ``fps`` within the radius into
    their components."""
    spark = fps.sparkSession
    distinct = ws.save(fps.select("__fp").distinct().withColumn("pop", F.bit_count("__fp").cast("int")), "distinct")
    by_pop = {r.pop: r.n for r in distinct.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # 65 rows
    total = sum(by_pop.values())
    rows = max(TILE_ROWS, int(TILE_ROWS * (total / (TILE_ROWS * TILES)) ** 0.5))
    tiles = [(p, k) for p in sorted(by_pop) for k in range(-(-by_pop[p] // rows))]
    number = {t: i for i, t in enumerate(tiles)}
    first = {p: number[(p, 0)] for p in by_pop}
    last = {p: first[p] + -(-by_pop[p] // rows) for p in by_pop}
    # A tile is paired with those of its own population count from itself on, and with those above.
    reach = {t: max(last[q] for q in by_pop if p <= q <= p + radius) for t, (p, _) in enumerate(tiles)}
    back = {t: min(first[q] for q in by_pop if p - radius <= q <= p) for t, (p, _) in enumerate(tiles)}
    shape = spark.createDataFrame(
        [(p, first[p], last[p] - first[p]) for p in sorted(by_pop)] or [(0, 0, 1)], "pop int, first int, n int"
    )
    span = spark.createDataFrame([(t, back[t], reach[t]) for t in range(len(tiles))] or [(0, 0, 0)], "tile int, lo int, hi int")
    packed = (
        distinct.join(F.broadcast(shape), "pop")  # at most 65 rows
        .withColumn("tile", F.col("first") + F.pmod(F.xxhash64("__fp"), F.col("n")).cast("int"))
        .groupBy("tile")
        .agg(F.collect_list("__fp").alias("fps"))  # a tile has about ``rows`` of them
    )
    # A row for each tile: joined by its number, as their count grows with the data.
    pairs = (
        packed.join(span, "tile")
        .withColumn("other", F.explode(F.sequence("lo", F.col("hi") - 1)))
        .select(F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).alias("second"), "fps")
    )

    def links(t: pa.Table) -> pa.Table:
        second = np.array(t["second"].to_pylist())
        sides = [np.array(x, np.int64).view(np.uint64) for x in t["fps"].to_pylist()]
        a = sides[int(np.flatnonzero(~second)[0])]
        alone = len(sides) == 1
        b = a if alone else sides[int(np.flatnonzero(second)[0])]
        both = a if alone else np.concatenate([a, b])
        found = Blocks(len(both))
        at = 0 if alone else len(a)
        for i in range(0, len(a), SIDE):
            for j in range(i if alone else 0, len(b), SIDE):
                near = np.bitwise_count(a[i : i + SIDE, None] ^ b[None, j : j + SIDE]) <= radius
                x, y = np.nonzero(near)
                if len(x):
                    found.add(x + i, y + j + at)
        x, y = found.forest()
        signed = both.view(np.int64)
        return pa.table({"a": pa.array(signed[x], pa.int64()), "b": pa.array(signed[y], pa.int64())})

    count = max(1, sum(reach[t] - t for t in range(len(tiles))))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(min(count, 8 * tasks), "x", "y").groupBy("x", "y").applyInArrow(links, "a long, b long")


def near_groups(fps: DataFrame, ws: Workspace, radius: int = 4) -> DataFrame:
    """(__fp, __group) for each distinct fingerprint; a group's name is one of its own."""
    links = near_links(fps, ws, radius)
    groups = connected_components(ws, links).select(F.col("node").alias("__fp"), F.col("component").alias("__group"))
    return ws.save(groups, "groups")


def with_group(fps: DataFrame, groups: DataFrame) -> DataFrame:
    """A fingerprint that links with none is a group of its own."""
    return fps.join(groups, "__fp", "left").withColumn("__group", F.coalesce("__group", "__fp"))


def simhash(docs: DataFrame, ws: Workspace, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fps = ws.save(fingerprints(own, k).select("doc_id", "__fp"), "fingerprints")
    groups = near_groups(fps, ws, radius)
    # The least id of each fingerprint, then of each group: both are sums made before a shuffle,
    # and written before they are joined, so that Spark can split a large group.
    least = ws.save(with_group(fps.groupBy("__fp").agg(F.min("doc_id").alias("least")), groups), "least")
    names = ws.save(least.groupBy("__group").agg(F.min("least").alias("component_id")), "names")
    of = ws.save(least.join(names, "__group").select("__fp", "component_id"), "of")
    return fps.join(of, "__fp").select(
        "doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, ws: Workspace, k: int = 4, radius: int = 4) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest
    id stays, of equal ids one row."""
    fp, row = free_names(docs, "__fp", "__row")
    rows = ws.save(fingerprints(docs, k, fp).withColumn(row, F.monotonically_increasing_id()), "rows")
    own = rows.select(column(fp).alias("__fp"), column(row).alias("__row"), F.col("doc_id").alias("__id"))
    groups = near_groups(own, ws, radius)
    key = F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")
    least = with_group(own.groupBy("__fp").agg(F.min(key).alias("key")), groups)
    stay = least.groupBy("__group").agg(F.min("key").alias("key")).select(F.col("key.__row").alias(row))
    return rows.join(stay, row, "left_semi").select(*columns(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"), Workspace(spark, "simhash"))
