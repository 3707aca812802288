"""Quality classifier on supervised subword embeddings.

A text's features are its words, its character n-grams (white space counts as one
sign) and a mark for each word that repeats the one before it, all hashed into
buckets. Every bucket has a learned vector; a text is the average of its features'
vectors, and softmax over a linear output gives the classes. Vectors and output are
trained together by stochastic gradient descent in numpy.

Training takes at most ``SAMPLE`` labelled documents of each class, weighed so that
the classes count as in all labelled rows. Rows in the held-out fold, whose
crc32(doc_id as text) mod 4 is 2, never train. Scoring reads every whole text: since
the output is linear, a bucket's vector and the output's weights come down to one
number, and a score is a mean of those.

Cases: a null text is an empty one, and has the score that the output's bias gives;
a null label, or one of a document that isn't there, is left out; a document whose
labels disagree has the more frequent one, of equally frequent ones 0; of labelled rows
with one id the least text is learned; a null
``doc_id`` has no fold and isn't held out; without any training row of one class
every score is the share of label 1 (0.5 without rows at all); repeated rows are
scored each; an empty table gives no rows; other columns are ignored or, in
``keep_good``, passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS, DIM = 1 << 16, 8
NGRAMS = (2, 3, 4)
SAMPLE, EPOCHS, RATE = 1500, 8, 2.0
THRESHOLD = 0.7
#: Characters worked on at once; a longer text is cut there, at white space if it has any.
PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_SPACES = np.zeros(0x3001, bool)
_SPACES[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = True


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(_ODD)) >> np.uint64(48)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at, at + PIECE) + 1
        end = end if end > at else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _ODD, np.uint64)
    up[:1] = 1
    down = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers(PIECE + 3)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's features, in arrays."""
    for piece in _pieces(text or ""):
        c = np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4")
        space = np.zeros(len(c), bool)
        low = c < len(_SPACES)
        space[low] = _SPACES[c[low]]
        keep = ~space
        keep[1:] |= ~space[:-1]  # of white space, the first sign
        c = np.where(space, 32, c)[keep].astype(np.uint64)
        c = np.concatenate([[np.uint64(32)], c[1:] if len(c) and c[0] == 32 else c])
        if c[-1] != 32:
            c = np.append(c, np.uint64(32))
        if len(c) < 2:
            continue
        # Words: differences of running sums of sign x odd number to the place.
        total = np.concatenate([[np.uint64(0)], np.cumsum(c * _UP[: len(c)])])
        cuts = np.flatnonzero(c == 32)
        word = (total[cuts[1:]] - total[cuts[:-1] + 1]) * _DOWN[cuts[:-1] + 1]
        yield _bucket(word, 1)
        yield _bucket(np.full(np.count_nonzero(word[1:] == word[:-1]), 7, np.uint64), 9)
        for n in NGRAMS:
            if len(c) >= n:
                h = np.zeros(len(c) - n + 1, np.uint64)
                for k in range(n):
                    h = h * np.uint64(_ODD) + c[k : len(c) - n + 1 + k]
                yield _bucket(h, 16 + n)


def counted(text: str | None) -> np.ndarray:
    """How often each bucket is among a text's features."""
    out = np.zeros(BUCKETS, np.int64)
    for f in features(text):
        out += np.bincount(f.view(np.int64), minlength=BUCKETS)
    return out


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float64), bias

    def score(self, text: str | None) -> float:
        total = n = 0.0
        for f in features(text):
            total += self.weights[f.view(np.int64)].sum()
            n += len(f)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -500, 500))))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """``docs``: buckets and their shares of each document."""
    share = float((labels * weight).sum() / weight.sum()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = rng.uniform(-1, 1, (DIM, 2)), np.log([1 - share, share])
    weight = weight / weight.mean()
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)).tolist():
            rate = RATE * (1 - step / steps)
            step += 1
            at, part = docs[i]
            hidden = part @ vectors[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[i]
            back = out @ p
            # A rare class's weight must not make steps that overshoot.
            out -= min(rate, 0.5) * np.outer(hidden, p)
            bias -= min(rate, 0.1) * 0.1 * p
            vectors[at] -= rate * np.outer(part, back)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    spark = docs.sparkSession
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg((F.avg("y") > 0.5).cast("int").alias("y"))
        .where(~held_out(F.col("doc_id")))
    )
    n = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    # Hashes pick about ``SAMPLE`` of a class; the limit makes the bound firm.
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = [
        r for y in sorted(n) for r in one.where((F.col("y") == y) & (order <= int(min(1, SAMPLE / n[y]) * (1 << 30)))).limit(SAMPLE * 5 // 4).collect()
    ]
    if not picked:
        return train([], np.empty(0, int), np.empty(0))
    chosen = spark.createDataFrame([(r.doc_id, r.y) for r in picked], "doc_id long, y int")

    def extract(batches):
        for pdf in batches:
            rows = []
            for doc, y, text in zip(pdf["doc_id"], pdf["y"], pdf["text"], strict=True):
                c = counted(text)
                at = np.flatnonzero(c)
                rows.append((doc, y, at.astype("<u4").tobytes(), (c[at] / max(1, c.sum())).astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "at", "part"])

    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most 2.5 x SAMPLE rows
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .mapInPandas(extract, "doc_id long, y int, at binary, part binary")
        .collect()
    )
    found.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in found], int)
    own = np.bincount(y, minlength=2)
    weight = np.array([n[k] / own[k] for k in y.tolist()])
    return train([(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r.part, "<f4").astype(float)) for r in found], y, weight)


def score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([model.score(t) for t in s], dtype=float)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return docs.where(score(F.col("text"), fit(docs, labels)) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
