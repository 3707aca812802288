"""Version resolution: the newest row of each key wins.

A changelog has a unique order: ``segment`` and ``seq``, or ``seq`` alone. A row is a
put (op 0) or a delete (op 1, a tombstone). Resolution is a window with rank 1, which
Spark cuts to one row a key before the shuffle; key predicates reach the scan through
it, and the test for tombstones stays above it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(log: DataFrame) -> list[str]:
    return [c for c in ("segment", "seq") if c in log.columns]


def in_range(start=None, end=None, key: str = "key") -> Column:
    """start <= key < end; an inverted range is empty."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(key) >= F.lit(start))
    if end is not None:
        out = out & (F.col(key) < F.lit(end))
    return out


def latest(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The newest row of each key, tombstones too."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_of(log)])
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def live(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    return latest(log, keys).where("op = 0")


def get(log: DataFrame, key) -> DataFrame:
    """At most one row; none for an absent or deleted key."""
    return live(log.where(F.col("key") == F.lit(key)))


def scan(log: DataFrame, start=None, end=None, ordered: bool = True) -> DataFrame:
    found = live(log.where(in_range(start, end)))
    return found.orderBy("key") if ordered else found


def scan_top(log: DataFrame, n: int, start=None, end=None, last: bool = False) -> DataFrame:
    return live(log.where(in_range(start, end))).orderBy(F.col("key").desc() if last else F.col("key")).limit(n)


def scan_prefix(log: DataFrame, prefix: bytes) -> DataFrame:
    """Live rows whose key starts with the bytes, as a half-open range."""
    stem = bytes(prefix).rstrip(b"\xff")
    end = stem[:-1] + bytes([stem[-1] + 1]) if stem else None
    return scan(log, bytes(prefix), end)


def get_many(log: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(key)`` with status absent, deleted or live, and the live value. Only
    probed keys are resolved."""
    wanted = probes.select("key").distinct()
    found = latest(log.join(wanted, "key", "left_semi")).select(F.col("key").alias("_k"), "op", "value")
    status = F.when(F.col("op").isNull(), "absent").when(F.col("op") != 0, "deleted").otherwise("live")
    return probes.join(found, F.col("key") == F.col("_k"), "left").select(
        *probes.columns, status.alias("status"), F.when(F.col("op") == 0, F.col("value")).alias("value")
    )


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live view after change ``seq``."""
    return live(log.where(F.col("seq") <= seq))


def history(log: DataFrame) -> DataFrame:
    """Each version with the change that ended it; null while it lasts."""
    by_key = Window.partitionBy("key").orderBy(*order_of(log))
    return log.withColumn("valid_to", F.lead("seq").over(by_key)).withColumnRenamed("seq", "valid_from")


def compact(log: DataFrame, segments: Sequence[int] | None = None) -> DataFrame:
    """Newest wins over some segments, whose tombstones are kept, or over all, where
    they are dropped. A partial result takes the place of its newest segment; other
    segments are unchanged."""
    if segments is None:
        return live(log)
    chosen = F.col("segment").isin(list(segments))
    merged = latest(log.where(chosen)).withColumn("segment", F.lit(max(segments)).cast(log.schema["segment"].dataType))
    return merged.unionByName(log.where(~chosen | F.col("segment").isNull()))


def unique_versions(log: DataFrame) -> bool:
    """Whether no two rows of a key have the same order; resolution needs it."""
    return log.groupBy("key", *order_of(log)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
