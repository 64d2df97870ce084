"""Point and range reads of a log: predicates that Catalyst pushes into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.errors import ReadStateError


def by_lsn(log: DataFrame, lsn: int) -> DataFrame:
    """The row of a sequence number."""
    return log.filter(F.col("read_lsn") == lsn)


def latest_of_key(log: DataFrame, key) -> DataFrame:
    """The last row of a key: none or one."""
    return latest_per_key(log.filter(F.col("key") == key))


def latest_per_key(log: DataFrame) -> DataFrame:
    """Each key's last row; partial maxima first, so a hot key is one row a task."""
    rest = [c for c in log.columns if c != "key"]
    last = log.groupBy("key").agg(F.max_by(F.struct(*rest), "read_lsn").alias("_last"))
    return last.select("key", *(F.col(f"_last.{c}").alias(c) for c in rest))


def by_offset(log: DataFrame, partition: int, offset: int) -> DataFrame:
    """The last row at an offset of a partition."""
    return offset_range(log, partition, offset, offset)


def offset_range(log: DataFrame, partition: int, first: int, last: int) -> DataFrame:
    """Rows of a partition from first to last, both included."""
    return log.filter((F.col("partition") == partition) & F.col("offset").between(first, last))


def by_topic(log: DataFrame, topic: str) -> DataFrame:
    return log.filter(F.col("topic") == topic)


def recent(log: DataFrame, now_ms: Column | int, max_age_ms: int, column: str = "timestamp") -> DataFrame:
    """Rows of at most that age."""
    return log.filter(F.lit(now_ms) - F.col(column) <= max_age_ms if isinstance(now_ms, int) else now_ms - F.col(column) <= max_age_ms)


def as_of(log: DataFrame, lsn: int | None, column: str = "read_lsn") -> DataFrame:
    """Rows up to a sequence number; None: all.  A table without the column can't be asked."""
    if column not in log.columns:
        raise ReadStateError(f"there is no column {column}")
    return log if lsn is None else log.filter(F.col(column) <= lsn)


def check_not_ahead(current: int, asked: int) -> None:
    if asked > current:
        raise ReadStateError(f"sequence number {asked} is ahead of the table's {current}")


def already_processed(candidates: DataFrame, committed: DataFrame) -> DataFrame:
    """Candidates at or below the last committed offset of their partition.

    committed: ``topic``, ``partition``, ``last``."""
    met = candidates.join(committed, ["topic", "partition"])
    return met.filter(F.col("offset") <= F.col("last")).drop("last")


def covered_ranges(candidates: DataFrame, committed: DataFrame) -> DataFrame:
    """Candidate offset ranges that lie within one committed range of their partition.

    Both: ``topic``, ``partition``, ``lo``, ``hi``.  A committed range covers a candidate if the largest
    ``hi`` of those that begin no later reaches it: one running maximum instead of a join on
    inequalities."""
    from pyspark.sql import Window

    marked = candidates.select("topic", "partition", "lo", "hi", F.lit(1).alias("_ask")).unionByName(committed.select("topic", "partition", "lo", "hi", F.lit(0).alias("_ask")))
    order = Window.partitionBy("topic", "partition").orderBy("lo", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("_ask") == 0, F.col("hi"))).over(order)
    return marked.withColumn("_reach", reach).filter((F.col("_ask") == 1) & (F.col("_reach") >= F.col("hi"))).select("topic", "partition", "lo", "hi")
