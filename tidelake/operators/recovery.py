"""Recovery as queries over the ledger's entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.operators.ledger import live_files


def incomplete_flushes(entries: DataFrame) -> DataFrame:
    """Flushes that began and didn't complete."""
    done = entries.filter("type = 'FlushDone'").select("batch_id")
    return entries.filter("type = 'FlushBegun'").select("batch_id", "row_count").join(done, "batch_id", "left_anti")


def orphan_files(entries: DataFrame) -> DataFrame:
    """Files that an incomplete flush wrote and no snapshot holds."""
    written = entries.filter("type = 'FileWritten'").select("batch_id", "file_path", "file_size_bytes")
    committed = entries.filter("type = 'SnapshotMade'").select("batch_id")
    open_ones = incomplete_flushes(entries).select("batch_id")
    return written.join(open_ones, "batch_id", "left_semi").join(committed, "batch_id", "left_anti")


def last_offsets(entries: DataFrame) -> DataFrame:
    """The last processed offset of each partition: covered by a committed file or range."""
    files = live_files(entries).select("topic", "partition", F.col("max_offset").alias("o"))
    ranges = entries.filter("type = 'RangeCommitted'").select("topic", "partition", F.col("last_offset").alias("o"))
    return files.unionByName(ranges).groupBy("topic", "partition").agg(F.max("o").alias("last_offset"))


def starting_offsets(entries: DataFrame) -> DataFrame:
    """Where each partition is read from."""
    return last_offsets(entries).select("topic", "partition", (F.col("last_offset") + 1).alias("start_offset"))


def summary(entries: DataFrame) -> DataFrame:
    """One row: counts of entries, flushes, orphans, files and rows."""
    kinds = entries.agg(
        F.count("*").alias("entries"), F.count_if(F.col("type") == "FlushBegun").alias("flushes_started"), F.count_if(F.col("type") == "FlushDone").alias("flushes_completed"),
        F.max(F.when(F.col("type") == "SnapshotMade", F.col("snapshot_id"))).alias("last_snapshot_id"),
    )
    orphans = orphan_files(entries).agg(F.count("*").alias("orphan_files"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("orphan_bytes"))
    files = live_files(entries).agg(F.count("*").alias("files"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.coalesce(F.max("read_lsn"), F.lit(0)).alias("last_lsn"))
    return kinds.join(orphans).join(files)  # a row each


def checkpoint_groups(entries: DataFrame, every: int) -> DataFrame:
    """Where checkpoints fall if there is one for so many entries, and what each stands for."""
    return entries.groupBy(F.floor((F.col("seq") - 1) / every).alias("checkpoint")).agg(F.max("seq").alias("last_seq"), F.count("*").alias("entries_covered"))
