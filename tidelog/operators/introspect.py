"""What a store's layers look like: sizes, indexes, amplification, replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bloom import sizing_columns
from ..functions.codec import LOG_HEAD, RUN_HEAD, SPARSE_STRIDE
from .metrics import fold_in_order
from .resolve import latest


def payload(head: int = 0, key: str = "key", value: str = "value") -> Column:
    """Bytes of a record; a tombstone's value has none."""
    size = F.octet_length(F.col(key)) + F.coalesce(F.when(F.col("op") == 0, F.octet_length(F.col(value))), F.lit(0))
    return (size + head).cast("long")


def flat(log: DataFrame) -> DataFrame:
    """Runs as they are stored: the newest row of each key in each segment."""
    return latest(log, ["segment", "key"])


def layer_of_hit(log: DataFrame) -> DataFrame:
    """Where a lookup of each key ends, and in how many segments it is."""
    return flat(log).groupBy("key").agg(F.max("segment").alias("hit_segment"), F.count(F.lit(1)).alias("copies"))


def read_amplification(log: DataFrame) -> DataFrame:
    """Segments that a lookup probes, newest first, until it ends."""
    runs = log.agg(F.max("segment").alias("newest"))  # one row
    return layer_of_hit(log).join(F.broadcast(runs)).select("key", (F.col("newest") - F.col("hit_segment") + 1).cast("long").alias("probed"))


def segment_stats(log: DataFrame) -> DataFrame:
    return (
        flat(log)
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(F.col("op") != 0, 1)).alias("n_tombstones"),
            F.min("key").alias("min_key"),
            F.max("key").alias("max_key"),
            F.sum(payload(RUN_HEAD)).alias("n_bytes"),
        )
    )


def sparse_index(log: DataFrame, stride: int = SPARSE_STRIDE) -> DataFrame:
    """Every 16th key of a run and the place of its record. A segment is bounded by the
    flush threshold, so its window is too."""
    by_key = Window.partitionBy("segment").orderBy("key")
    size = payload(RUN_HEAD)
    return (
        flat(log)
        .withColumn("_n", F.row_number().over(by_key))
        .withColumn("place", F.sum(size).over(by_key) - size)
        .where((F.col("_n") - 1) % stride == 0)
        .select("segment", "key", "place")
    )


def floor_in_index(index: DataFrame, key) -> DataFrame:
    """For each segment, where a search for the key begins; 0 before its first entry."""
    return index.groupBy("segment").agg(F.coalesce(F.max(F.when(F.col("key") <= F.lit(key), F.col("place"))), F.lit(0)).alias("place"))


def bloom_parameters(log: DataFrame, rate: float = 0.01) -> DataFrame:
    counts = flat(log).groupBy("segment").agg(F.count(F.lit(1)).alias("n_keys"))
    bits, hashes = sizing_columns(F.col("n_keys"), rate)
    fpr = F.pow(1 - F.exp(-F.col("n_hashes") * F.col("n_keys") / F.col("n_bits")), F.col("n_hashes"))
    return counts.withColumn("n_bits", bits).withColumn("n_hashes", hashes).withColumn("expected_fpr", fpr)


def log_offsets(log: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Where each record of the log ends. Chunks of the log are summed first and each
    then runs on from the chunks before, so no task orders the whole log."""
    rows = log.withColumn("_size", payload(LOG_HEAD)).withColumn("_chunk", F.floor(F.col("seq") / chunk))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_chunk").agg(F.sum("_size").alias("_all"))  # a row for each chunk
        .select("_chunk", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_chunk").orderBy("seq")
    return (
        rows.withColumn("_in", F.sum("_size").over(inside)).join(starts, "_chunk")
        .select("seq", (F.col("_start") + F.col("_in")).alias("end_offset"))
    )


def memtable_bytes(log: DataFrame) -> DataFrame:
    """Entries and bytes of a buffer that took these changes."""
    return latest(log).agg(F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum(payload()), F.lit(0)).cast("long").alias("n_bytes"))


def valid_prefix(log: DataFrame, valid: Column) -> DataFrame:
    """Rows before the first one that isn't valid; a null counts as not valid."""
    bad = log.where(~F.coalesce(valid, F.lit(False))).agg(F.min("seq").alias("_bad"))  # one row
    return log.join(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")


def flush_epochs(log: DataFrame, threshold: int, store: str = "store") -> DataFrame:
    """The buffer that each change goes to: one is flushed when its bytes reach the
    threshold, and the next begins empty. A fold in order, for each store on its own; its
    state is a buffer's keys, which the threshold bounds."""

    def fold(state, part: pd.DataFrame):
        held, size, epoch = state
        out = []
        for key, add in zip(part["key"], part["_size"], strict=True):
            size += int(add) - held.get(key, 0)
            held[key] = int(add)
            out.append(epoch)
            if size >= threshold:
                held, size, epoch = {}, 0, epoch + 1
        return (held, size, epoch), pd.DataFrame({store: part[store], "seq": part["seq"], "epoch": out})

    rows = log.select(store, "seq", "key", payload().alias("_size"))
    kind = dict(rows.dtypes)
    return fold_in_order(rows, [store], "seq", fold, lambda: ({}, 0, 0), f"{store} {kind[store]}, seq {kind['seq']}, epoch long")


def write_amplification(log: DataFrame) -> DataFrame:
    """Bytes written to the log and to runs, against the user's bytes."""
    runs = flat(log).agg(F.sum(payload(RUN_HEAD)).alias("run_bytes"))
    logged = log.agg(F.sum(payload()).alias("user_bytes"), F.sum(payload(LOG_HEAD)).alias("log_bytes"))
    return logged.join(F.broadcast(runs)).withColumn(
        "amplification", (F.col("log_bytes") + F.col("run_bytes")) / F.col("user_bytes")
    )
