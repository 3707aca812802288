"""Tables as changelogs: key, seq, op, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered_key(c: Column) -> Column:
    """A text key for a whole number of 64 bits, one for each number and in their order:
    0 or 1 for its sign, then 19 digits, of a negative one those of its distance from the least."""
    n = c.cast("long")
    return F.concat(F.when(n < 0, "0").otherwise("1"), F.lpad(n.bitwiseAND(F.lit((1 << 63) - 1)).cast("string"), 19, "0"))


def key_of(n: int) -> str:
    """The same for a number at hand."""
    return ("0" if n < 0 else "1") + str(n & (1 << 63) - 1).rjust(19, "0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, run_rows: int = 1000) -> DataFrame:
    """Errors delete a user's key, other events put their properties."""
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / run_rows).cast("long").alias("segment"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").cast("int").alias("op"),
        ordered_key(F.col("user_id")).alias("key"),
        F.col("props").alias("value"),
        "ts",
        "event_type",
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").cast("int").alias("op"),
        ordered_key(F.col("o_custkey")).alias("key"),
        F.col("o_totalprice").alias("value"),
    )


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("seq"), F.lit(0).alias("op"), ordered_key(F.col("conv_id")).alias("key"), F.col("text").alias("value")
    )
