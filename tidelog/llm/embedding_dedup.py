"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; the pairs of
codes form a grid of cells and every vector is filed in the cell of its nearest codes.
A query visits cells by multi-sequence traversal: in ascending order of how far each
half would have to move to fall under the other code (its distance to the plane
midway between the two codes). It stops when the order passes a limit, and every
vector filed in a visited cell is verified by cosine in double precision.

The limit is set for a target recall: the larger of the quantile over neighbours made
at the very edge of the radius, and over the true neighbours of a sample of queries
compared with all rows but themselves; ``pairs`` and ``recall`` of the index say how
many those were and how many of them it reaches. Codebooks and limit are fitted on
samples of at most ``SAMPLE`` vectors and ``QUERIES`` queries; all rows are indexed and
queried.

Codes grow with the square root of the rows, so cells keep about ``CELL_ROWS`` rows, and
the cells that a query visits grow about with that root too: entries and comparisons
grow as the rows to the power 1.5. From ``MOST_CODES`` squared times ``CELL_ROWS`` rows on
(200 million) cells grow with the rows, and comparisons with their square.

Equal vectors are taken together first. Cells and their queries are cut into tiles of
about ``TILE`` rows, so a crowded cell becomes many tasks, and a tile sends out sums
and one link for each vector that it joins to another, not every pair.

Cases: a vector that is null, zero, or has null or non-finite parts, or not as many
parts as most of the sample, links with nothing; a null ``vec_id`` is larger than any
other; repeated rows count as vectors of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, connected_components, table
from .numpy_links import Blocks

THRESHOLD, RECALL = 0.9, 0.98
#: Bounds of what is fitted on, and of the codes for each half.
SAMPLE, QUERIES, MOST_CODES = 20_000, 256, 2048
#: Cells whose table is broadcast, at most.
BROADCAST_CELLS = 1 << 18
CELL_ROWS, TILE, SIDE = 50, 4096, 1024
BINS = 400  # of the traversal's order, whose values are below 1


def nearest_codes(half: np.ndarray, codes: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """k-means centres of ``half``'s rows, begun at rows drawn by ``seed``."""
    centres = half[np.random.default_rng(seed).choice(len(half), codes, replace=False)].copy()
    for _ in range(rounds):
        near = (half @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        n = np.bincount(near, minlength=codes)
        total = np.zeros_like(centres)
        np.add.at(total, near, half)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.codes = [first, second]
        self.cut = first.shape[1]
        # Equal codes cost nothing to change between; no gap is quite zero.
        self.gaps = [np.maximum(np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)), 1e-9) for c in self.codes]
        self.limit = 0.0
        self.pairs, self.recall = 0, 1.0  # true neighbours of the sampled queries, and the share that the limit reaches

    @classmethod
    def fit(cls, sample: np.ndarray, codes: int, rounds: int = 10) -> MultiIndex:
        cut = sample.shape[1] // 2
        codes = min(codes, len(sample))
        return cls(nearest_codes(sample[:, :cut], codes, rounds, 1), nearest_codes(sample[:, cut:], codes, rounds, 2))

    def moves(self, unit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each half, the squared way to each code's side; and the home cells."""
        out, home = [], np.zeros(len(unit), np.int64)
        for half, codes, gaps in zip((unit[:, : self.cut], unit[:, self.cut :]), self.codes, self.gaps, strict=True):
            d = (codes * codes).sum(1) - 2 * half @ codes.T
            near = d.argmin(1)
            out.append(((d - d[np.arange(len(d)), near][:, None]) / (2 * gaps[near])) ** 2)
            home = home * len(codes) + near
        return out, home

    def order(self, moves: list[np.ndarray], rows: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """How far on the traversal of ``rows`` the cells ``homes`` stand."""
        n = len(self.codes[1])
        return np.sqrt(moves[0][rows, homes // n] + moves[1][rows, homes % n])

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """Multi-sequence traversal of one query's cells, up to the limit."""
        n = len(second)
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a].tolist(), second[b].tolist()
        a, b = a.tolist(), b.tolist()
        most, heap = self.limit**2, [(x[0] + y[0], 0, 0)]
        while heap:
            far, i, j = heapq.heappop(heap)
            if far > most:
                return
            yield a[i] * n + b[j]
            # Each cell has one way in: along the second half, or from its row's first cell.
            if j + 1 < len(y):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def at_radius(unit: np.ndarray, cosine: float, seed: int = 3) -> np.ndarray:
    """A neighbour of each row at just this cosine, in a random direction."""
    noise = np.random.default_rng(seed).standard_normal(unit.shape)
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * unit + np.sqrt(1 - cosine**2) * noise


def to_units(column: pa.Array, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    # Scaled first: the squares of very large or small parts must not leave the range.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame, int]:
    """Rows with the hashes of their vector; the distinct usable vectors with a key;
    and how many parts they have."""
    v = F.col("embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(odd(x), F.lit(True))) & F.exists(v, lambda x: x != 0)
    rows = (
        vectors.select(F.col("vec_id").cast("long"), "embedding")
        .withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("h1", F.when(F.col("usable"), F.xxhash64(v)))
        .withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit("second"), F.reverse(v))))
    )
    kinds = rows.where("usable").select(F.size(v).alias("size")).groupBy("size").count()
    size = kinds.orderBy(F.desc("count"), "size").first()
    size = size["size"] if size else 0
    grouped = (
        rows.where(F.col("usable") & (F.size(v) == size))
        .groupBy("h1", "h2")
        .agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
        .withColumn("key", F.monotonically_increasing_id())
    )
    return rows.drop("embedding", "usable"), ws.save(grouped, "distinct"), size


def fit(distinct: DataFrame, kind: str, threshold: float, recall: float) -> MultiIndex:
    total = distinct.count()
    share = min(1.0, SAMPLE / max(1, total))
    # Hashes pick the sample: about ``SAMPLE`` rows, and no more than half as many again.
    picked = distinct.where(F.pmod("h2", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else distinct
    rows = picked.select("key", "embedding").limit(SAMPLE * 3 // 2).collect()
    sample = to_units(pa.array([np.array(r.embedding, np.float64).tobytes() for r in rows]), "<f8")
    codes = int(min(MOST_CODES, max(4, round((total / CELL_ROWS) ** 0.5))))
    index = MultiIndex.fit(sample, codes)
    moves, _ = index.moves(sample)
    edge = index.order(moves, np.arange(len(sample)), index.moves(at_radius(sample, threshold))[1])
    index.limit = float(np.quantile(edge, recall)) + 1e-9

    queries, own = sample[:QUERIES], np.array([r.key for r in rows[:QUERIES]])
    asked = [m[: len(queries)] for m in moves]

    def measure(batches):
        for batch in batches:
            unit = to_units(batch["vec"], kind)
            home = index.moves(unit)[1]
            near = queries @ unit.T >= threshold
            near &= own[:, None] != batch["key"].to_numpy()  # a vector isn't its own neighbour
            q, r = np.nonzero(near)
            bins, n = np.unique((index.order(asked, q, home[r]) * BINS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n.astype(np.int64))], ["bin", "n"])

    bins = packed(distinct, kind).mapInArrow(measure, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    index.pairs, had = sum(r.n for r in bins), 0
    for r in bins:  # at most a few hundred
        if (r.bin + 1) / BINS > index.limit and had >= recall * index.pairs:
            break
        had += r.n
        index.limit = max(index.limit, (r.bin + 1) / BINS)
    index.recall = had / index.pairs if index.pairs else 1.0
    return index


def packed(distinct: DataFrame, kind: str) -> DataFrame:
    def pack(batches):
        for batch in batches:
            v = batch["embedding"]
            flat = v.values.slice(v.offsets[0].as_py(), v.offsets[-1].as_py() - v.offsets[0].as_py()).to_numpy(zero_copy_only=False)
            rows = flat.astype(kind).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["n"], pa.array([r.tobytes() for r in rows], pa.binary())], ["key", "n", "vec"])

    return distinct.select("key", "n", "embedding").mapInArrow(pack, "key long, n long, vec binary")


def near(distinct: DataFrame, index: MultiIndex, kind: str, ws: Workspace, threshold: float) -> DataFrame:
    """Rows (a, b, n): b null: vector a has links to n others not equal to it; else a
    link that joins a and b."""

    def file(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                moves, homes = index.moves(to_units(part["vec"], kind))
                cells = [list(index.visit(moves[0][i], moves[1][i])) for i in range(len(part))]
                # Each vector asks in the cells that it visits, and is filed in its own.
                n = [len(c) + 1 for c in cells]
                row = pa.array(np.repeat(np.arange(len(part)), n))
                cell = np.array([x for c, h in zip(cells, homes.tolist(), strict=True) for x in (*c, h)], np.int64)
                asks = np.ones(len(cell), bool)
                asks[np.cumsum(n) - 1] = False
                yield pa.RecordBatch.from_arrays(
                    [part["key"].take(row), part["n"].take(row), part["vec"].take(row), pa.array(cell), pa.array(np.repeat(homes, n)), pa.array(asks)], schema=filed
                )

    filed = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("vec", pa.binary()), ("cell", pa.int64()), ("home", pa.int64()), ("asks", pa.bool_())])
    entries = ws.save(packed(distinct, kind).mapInArrow(file, "key long, n long, vec binary, cell long, home long, asks boolean"), "entries")
    tiles = lambda asks: F.ceil(F.count(F.when(F.col("asks") == asks, 1)) / F.lit(TILE))
    # Only cells with something to verify; there are as many as pairs of codes, at most.
    cells = entries.groupBy("cell").agg(tiles(True).alias("ask_tiles"), tiles(False).alias("home_tiles")).where("home_tiles > 0")
    cells = ws.save(cells, "cells")
    few = len(index.codes[0]) * len(index.codes[1]) <= BROADCAST_CELLS
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))
    dealt = (
        entries.join(F.broadcast(cells) if few else cells, "cell")
        .withColumn("x", F.explode(F.when(F.col("asks"), every("home_tiles")).otherwise(F.array(own("home_tiles")))))
        .withColumn("y", F.explode(F.when(F.col("asks"), F.array(own("ask_tiles"))).otherwise(every("ask_tiles"))))
    )

    def verify(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key, n, home = (t[c].to_numpy() for c in ("key", "n", "home"))
        asks = np.array(t["asks"].to_pylist())
        unit = to_units(t["vec"].combine_chunks(), kind)
        h, p = np.flatnonzero(~asks), np.flatnonzero(asks)
        # A vector is in its own cell's tiles twice, filed and asking: both are one item.
        items, place = np.unique(key, return_inverse=True)
        found, count = Blocks(len(items)), np.zeros(len(items), np.int64)
        moves = index.moves(unit[h])[0] if len(h) else None
        for i in range(0, len(h), SIDE):
            for j in range(0, len(p), SIDE):
                x, y = np.nonzero(unit[h[i : i + SIDE]] @ unit[p[j : j + SIDE]].T >= threshold)
                x, y = x + i, y + j
                other = key[h[x]] != key[p[y]]
                x, y = x[other], y[other]
                if not len(x):
                    continue
                np.add.at(count, place[p[y]], n[h[x]])
                # The filed side finds the asking one in that one's cell, unless it doesn't go there.
                alone = index.order(moves, x, home[p[y]]) > index.limit
                np.add.at(count, place[h[x[alone]]], n[p[y[alone]]])
                found.add(place[h[x]], place[p[y]])
        some = np.flatnonzero(count)
        a, b = found.forest()
        return pa.table(
            {
                "a": pa.array(np.concatenate([items[some], items[a]]), pa.int64()),
                "b": pa.array([None] * len(some) + items[b].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([count[some], np.zeros(len(a), np.int64)]), pa.int64()),
            }
        )

    return dealt.groupBy("cell", "x", "y").applyInArrow(verify, "a long, b long, n long")


def near_dedup(vectors: DataFrame, ws: Workspace, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    part = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(part, T.FloatType) else "<f8"
    if kind == "<f8":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows, distinct, _ = distinct_vectors(vectors, ws)
    lone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not distinct.limit(1).count():
        return lone
    index = fit(distinct, kind, threshold, recall)
    found = ws.save(near(distinct, index, kind, ws, threshold), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    groups = connected_components(ws, found.where("b is not null").select("a", "b"))
    # Written before they are joined, so that Spark can split a large component.
    named = ws.save(
        distinct.select("h1", "h2", "key", "n", "least")
        .join(groups.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key")),
        "named",
    )
    least = ws.save(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    info = (
        named.join(least, "component")
        .join(counts, "key", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    )
    return rows.join(ws.save(info, "info"), ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.when(F.col("n_links").isNotNull(), F.col("vec_id").eqNullSafe(F.col("component_id"))).otherwise(True).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"), Workspace(spark, "embedding-dedup"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
