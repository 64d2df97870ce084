"""Consistent reads: committed files and the tail of the log, divided by watermark, never both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.lookups import as_of, check_not_ahead


def watermarks(log: DataFrame, column: str = "offset") -> DataFrame:
    """The last committed offset of each partition."""
    return log.groupBy("topic", "partition").agg(F.max(column).alias("committed_offset"))


def lag(current: DataFrame, committed: DataFrame) -> DataFrame:
    """How far each partition's last offset is ahead of the committed one (0 where none is)."""
    last = current.groupBy("topic", "partition").agg(F.max("offset").alias("current_offset"))
    met = last.join(committed, ["topic", "partition"], "left")
    return met.withColumn("lag", F.col("current_offset") - F.coalesce("committed_offset", F.lit(0)))


def hot_tail(log: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows after their partition's watermark (one row a partition: a small table)."""
    met = log.join(committed.select("topic", "partition", "committed_offset"), ["topic", "partition"], "left")
    return met.filter(F.col("offset") > F.coalesce("committed_offset", F.lit(-1))).drop("committed_offset")


def scan(cold: DataFrame, hot: DataFrame, lsn: int | None = None) -> DataFrame:
    """Cold and hot rows up to a sequence number; a column that one side lacks is null there."""
    return as_of(cold, lsn).unionByName(as_of(hot, lsn), allowMissingColumns=True)


def flush_manifest(log: DataFrame, batch_rows: int) -> DataFrame:
    """The files that flushes of so many rows write: one for each batch, partition and UTC day, with
    the bounds of offsets and sequence numbers."""
    from tidelake.functions.exprs import time_bucket

    batch = F.floor((F.col("read_lsn") - 1) / batch_rows).alias("batch_id")
    return log.groupBy(batch, "topic", "partition", time_bucket(F.col("timestamp")).alias("event_date")).agg(
        F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"), F.min("read_lsn").alias("min_lsn"), F.max("read_lsn").alias("max_lsn"),
        F.min("timestamp").alias("first_timestamp"), F.count("*").alias("row_count"),
    )


def files_visible_at(files: DataFrame, lsn: int) -> DataFrame:
    """Files that may hold rows up to a sequence number; their rows still have to be filtered."""
    return files.filter(F.col("min_lsn") <= lsn)


class Snapshot:
    """A table as of a sequence number: files from the ledger, and a log's rows beyond them."""

    def __init__(self, spark: SparkSession, files: DataFrame, log: DataFrame | None = None, lsn: int | None = None):
        self.spark, self.log, self.lsn = spark, log, lsn
        current = files.agg(F.max("read_lsn")).first()[0] or 0
        if log is None and lsn is not None:
            check_not_ahead(current, lsn)
        self.files = files if lsn is None else files_visible_at(files, lsn)

    def paths(self) -> list[str]:
        """Paths of the files in reach: as many as the ledger's live files with a low enough bound."""
        return [r.file_path for r in self.files.select("file_path").orderBy("file_path").collect()]

    def watermarks(self) -> DataFrame:
        return watermarks(self.files, "max_offset")

    def read(self) -> DataFrame:
        """The visible rows."""
        paths = self.paths()
        cold = self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None
        hot = hot_tail(self.log, self.watermarks()) if self.log is not None else None
        if cold is None or hot is None:
            only = cold if hot is None else hot
            return as_of(only, self.lsn) if only is not None else self.spark.createDataFrame([], "read_lsn long")
        return scan(cold, hot, self.lsn)
