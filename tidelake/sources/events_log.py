"""The ``events`` table as a message log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event ids of one range; a range of one partition is numbered in one task.
RANGE = 1 << 16


def with_offsets(rows: DataFrame, partition: str, order: str, width: int = RANGE) -> DataFrame:
    """Adds ``offset``: 0, 1, … in each partition by a whole-numbered, unique order.

    Ranges of the order are counted, the counts summed up (a small table: ranges times partitions),
    and rows numbered within their range, so no task holds a partition of the log."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(partition, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(partition, "_range", F.coalesce(before, F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(partition, "_range").orderBy(order))
    numbered = ranged.withColumn("_nth", nth).join(base, [partition, "_range"])
    return numbered.withColumn("offset", (F.col("_base") + F.col("_nth") - 1).cast("long")).drop("_range", "_base", "_nth")


def event_log(spark: SparkSession, sf_dir: str, partitions: int = 4, offsets: bool = True, where: Column | None = None) -> DataFrame:
    """``key``, ``value``, ``topic``, ``partition``, ``offset``, ``timestamp``, ``read_lsn``: users are
    keys, properties are values; sequence numbers follow event ids.  where: a filter on events that
    doesn't change offsets, so only for calls without them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if where is not None:
        events = events.filter(where)
    log = events.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        F.lit("events").alias("topic"),
        (F.col("user_id") % partitions).cast("int").alias("partition"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        (F.col("event_id") + 1).alias("read_lsn"),
    )
    if not offsets:
        return log
    return with_offsets(log, "partition", "read_lsn").select("key", "value", "topic", "partition", "offset", "timestamp", "read_lsn")
