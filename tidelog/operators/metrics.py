"""Operational metrics as queries: rates, totals, deltas, averages and events."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The smoothing of the dashboard's averages.
SMOOTHING = 0.25
COUNTERS = ("compaction_count", "wal_size_bytes", "sstable_count", "recovery_time_ms", "total_writes", "total_reads")


def sliding_rate(events: DataFrame, seconds: int, ts: str = "ts", by: str | None = None) -> DataFrame:
    """Adds the count of events not older than ``seconds`` at each event, the boundary
    included, and its rate.

    Slices of the time line, each as long as the window and joined by the end of the one
    before it, are counted apart: an event needs only its own slice and the last.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    rows = events.withColumn("_t", t).withColumn("_own", F.lit(True)).withColumn("_slice", F.floor(t / width))
    carried = rows.withColumn("_slice", F.col("_slice") + 1).withColumn("_own", F.lit(False))
    frame = Window.partitionBy(*([by] if by else []), "_slice").orderBy("_t").rangeBetween(-width, 0)
    return (
        rows.unionByName(carried)
        .withColumn("in_window", F.count(F.lit(1)).over(frame))
        .where("_own")
        .drop("_t", "_own", "_slice")
        .withColumn("rate", F.col("in_window") / float(seconds))
    )


def totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total_writes"), F.count(F.when(F.col("op") == 0, 1)).alias("puts"), F.count(F.when(F.col("op") != 0, 1)).alias("deletes")
    )


def deltas(polls: DataFrame, counter: str, order: str = "poll", by: str | None = None) -> DataFrame:
    """Adds how much a counter rose since the poll before; a restart counts as none."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    return polls.withColumn("delta", F.greatest(F.lit(0).cast("long"), F.col(counter) - F.lag(counter, 1, 0).over(w)))


def fold_in_order(rows: DataFrame, by: list[str], order: str, step: Callable, start: Callable, schema: str) -> DataFrame:
    """A fold over each group's rows in their order. ``start()`` makes a state, ``step(state,
    part)`` takes a pandas frame of a group's next rows and gives (state, frame or None).
    Groups are dealt out and sorted by Spark, whose sort spills, and go by in Arrow batches:
    a task holds a batch and one state, however many rows a group has."""

    def run(batches):
        last, state = None, None
        for pdf in batches:
            keys = pdf[by].apply(tuple, axis=1) if by else pd.Series([()] * len(pdf))
            cuts = [0, *(np.flatnonzero((keys != keys.shift()).to_numpy()[1:]) + 1).tolist(), len(pdf)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if last is None or keys.iloc[lo] != last:
                    last, state = keys.iloc[lo], start()
                state, out = step(state, pdf.iloc[lo:hi])
                if out is not None:
                    yield out

    dealt = rows.repartition(*by) if by else rows.repartition(1)
    return dealt.sortWithinPartitions(*by, order).mapInPandas(run, schema)


def ema(polls: DataFrame, value: str, order: str = "poll", by: str | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """The average after the last poll, rounded to a whole number at every poll. Each poll's
    average is told, and the one of the last poll kept."""
    groups = [by] if by else []
    kinds = dict(polls.dtypes)

    def step(state: float, part: pd.DataFrame):
        for x in part[value].to_numpy(float):
            state = math.floor(state * (1 - smoothing) + x * smoothing + 0.5)
        return state, pd.DataFrame({**({by: part[by].iloc[-1:].to_numpy()} if by else {}), "at": part[order].iloc[-1:].to_numpy(), "ema": [float(state)]})

    told = fold_in_order(
        polls.select(*groups, order, value), groups, order, step, lambda: 0.0, "".join(f"{c} {kinds[c]}, " for c in groups) + f"at {kinds[order]}, ema double"
    )
    return told.groupBy(*groups).agg(F.coalesce(F.max_by("ema", "at"), F.lit(0.0)).alias("ema"))


def rolling_series(polls: DataFrame, n: int = 40, order: str = "poll") -> DataFrame:
    return polls.orderBy(F.col(order).desc()).limit(n)


def metric_events(polls: DataFrame, order: str = "poll", by: str | None = None) -> DataFrame:
    """``polls`` with compaction_count, sstable_count and recovery_time_ms to one row per
    event: a compaction when its counter rises, a flush when there are more runs than
    before and more than one, a recovery at the first poll that took time for one."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(order)
    before = lambda c: F.lag(c, 1, 0).over(w)
    seen = F.coalesce(F.max(F.col("recovery_time_ms") > 0).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return (
        polls.select(
            *([by] if by else []), order,
            F.array_compact(F.array(
                F.when(F.col("compaction_count") > before("compaction_count"), F.lit("compaction")),
                F.when((F.col("sstable_count") > before("sstable_count")) & (F.col("sstable_count") > 1), F.lit("flush")),
                F.when((F.col("recovery_time_ms") > 0) & ~seen, F.lit("recovery")),
            )).alias("events"),
        )
        .select(*([by] if by else []), order, F.explode("events").alias("event"))
    )


def recent_events(events: DataFrame, n: int = 6, order: str = "poll") -> DataFrame:
    """The newest events; of one poll, in the order of their names, the last first."""
    return events.orderBy(F.col(order).desc(), F.col("event").desc()).limit(n)


def snapshot_json(snapshots: DataFrame) -> DataFrame:
    """The snapshot text: eight fields, rates at two decimals."""
    rates = [F.format_string(f'"{c}":%.2f', F.col(c).cast("double")) for c in ("writes_per_sec", "reads_per_sec")]
    counts = [F.format_string(f'"{c}":%d', F.col(c).cast("long")) for c in COUNTERS]
    return snapshots.select(F.concat(F.lit("{"), F.concat_ws(",", *rates, *counts), F.lit("}")).alias("json"))


def parse_snapshot(text: str) -> dict:
    return json.loads(text)


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(F.format_string("%.1f KB", n / 1024.0))
