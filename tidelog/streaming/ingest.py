"""Streams of changes into a store, and live rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store


def ingest(changes: DataFrame, store: Store, source: str, checkpoint: str, **trigger):
    """Starts a query that appends each micro-batch to the store. The manifest holds the
    last batch of each source, so a batch that is sent again changes nothing."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: store.write(batch, source, n) and None)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def live_rate(events: DataFrame, ts: str = "ts", seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """Events a second in windows of event time, for a streaming or a batch table."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", late)
    return (
        timed.groupBy(F.window("_ts", f"{seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("window.start").alias("window_start"), "n_events", (F.col("n_events") / float(seconds)).alias("rate"))
    )


def live_latest(changes: DataFrame) -> DataFrame:
    """The newest row of each key as state that a stream keeps up."""
    return changes.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("last")).select("key", "last.seq", "last.op", "last.value")


def tabulate(aggregated: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a streaming aggregation over what there is, and gives its whole result as a
    table. Each micro-batch writes a folder of its own; the last one's is read."""
    spark, schema = aggregated.sparkSession, aggregated.schema
    done: list[int] = []

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{n}")
        done.append(n)

    query = aggregated.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/{max(done)}") if done else spark.createDataFrame([], schema)


def rate_changes(spark, rows_per_second: int = 200) -> DataFrame:
    """An endless stream of puts, for demonstrations: ``live_00000000`` and so on."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(
        F.format_string("live_%08d", "value").cast("binary").alias("key"),
        F.lit(0).alias("op"),
        F.format_string("value_%08d_____", "value").cast("binary").alias("value"),
        F.col("value").alias("order"),
    )
