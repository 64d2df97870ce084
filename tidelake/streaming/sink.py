"""The streaming sink: each micro-batch is decoded, gated, numbered, written and committed once.

A batch's files go to paths of its own and become visible only by the ledger version that names
them, with the range of offsets of each partition; a batch that is replayed after that finds its
ranges covered and does nothing.  Rows that a batch doesn't commit stay owned by the source.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelake.errors import CommitConflict, SchemaError
from tidelake.functions.exprs import time_bucket
from tidelake.operators.health import Health
from tidelake.operators.ledger import Coordinator, Ledger
from tidelake.operators.lookups import covered_ranges
from tidelake.operators.schema import Field, TableSchema, diff_fields, evolve

#: Rows of one range when sequence numbers are given out.
RANGE = 1 << 16


class NumbersTaken(Exception):
    """Another writer committed to the table while a batch was written."""


def number_rows(batch: DataFrame, base: int) -> DataFrame:
    """Adds ``read_lsn``: base, base + 1, … by topic, partition and offset.

    Ranges of offsets are counted and summed up, rows are numbered within their range; no task
    holds the batch."""
    rows = batch.withColumn("_range", F.floor(F.col("offset") / RANGE))
    keys = ["topic", "partition", "_range"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))  # ranges, not rows
    counts = counts.select(*keys, (F.coalesce(before, F.lit(0)) + base).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("offset"))
    return rows.withColumn("_nth", nth).join(counts, keys).withColumn("read_lsn", (F.col("_base") + F.col("_nth") - 1).cast("long")).drop("_range", "_nth", "_base")


@dataclass
class Gate:
    """What happens when a batch's fields differ from the table's.

    mode: ``auto`` adds optional fields, ``manual`` pauses on them.  on_breaking: ``pause``, ``fail`` or
    ``skip_message`` (which pauses too)."""

    table: TableSchema
    mode: str = "auto"
    on_breaking: str = "pause"
    min_interval_s: float = 0.0
    clock: Callable[[], float] = time.monotonic
    paused: bool = False
    _last: float | None = None

    def admit(self, fields: list[Field], older: bool = False) -> list[dict]:
        """Ledger entries of the change that the fields make; raises or pauses if they can't be taken."""
        d = diff_fields(self.table, fields, allow_missing=older)
        if d.breaking:
            self.paused = self.on_breaking != "fail"
            raise SchemaError("; ".join(d.breaking))
        if not d.added:
            return []
        if self.mode == "manual":
            self.paused = True
            raise SchemaError(f"new fields: {[f.name for f in d.added]}")
        if self._last is not None and (wait := self.min_interval_s - (self.clock() - self._last)) > 0:
            time.sleep(wait)
        self._last = self.clock()
        old, self.table = self.table, evolve(self.table, list(d.added))
        added = [{"name": f.name, "type": str(f.type), "doc": f.doc} for f in self.table.fields[len(old.fields) :]]
        return [{"type": "SchemaChanged", "fields_added": added, "schema_before": old.schema_id, "schema_after": self.table.schema_id}]


@dataclass
class Sink:
    """Writes micro-batches of messages to a table."""

    ledger: Ledger
    location: str
    database: str = "default"
    table: str = "events"
    decode: Callable[[DataFrame], DataFrame] | None = None
    gate: Gate | None = None
    fields_of: Callable[[DataFrame], list[Field]] | None = None
    older: bool = False  # batches may lack fields of the table
    hourly: bool = False
    compression: str = "snappy"
    rows_per_file: int = 5_000_000
    retries: int = 4
    checkpoint_entries: int = 10_000
    checkpoint_s: float = float("inf")
    health: Health = field(default_factory=Health)
    batches: int = 0
    _since: int = 0
    _last: float = field(default_factory=time.monotonic)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        if self.gate is not None and self.gate.paused:
            raise SchemaError("paused by a schema change")
        ranges = batch.groupBy("topic", "partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"))
        batch = batch.persist()
        try:
            ranges = ranges.collect()  # a row a partition of the source
            if ranges:
                self._write(batch, batch_id, ranges)
        except SchemaError:
            self.health.mark("schema", "degraded")
            self.health.block("schema", "a breaking change")
            raise
        finally:
            batch.unpersist()
        self.batches += 1

    def _covered(self, entries: DataFrame, ranges: list) -> bool:
        """Whether all the batch's ranges have been committed; a batch is committed whole or not."""
        spark = entries.sparkSession
        asked = spark.createDataFrame([(r.topic, r.partition, r.lo, r.hi) for r in ranges], "topic string, partition int, lo long, hi long")
        done = entries.filter((F.col("type") == "RangeCommitted") & (F.col("table") == self.table)).select("topic", "partition", F.col("first_offset").alias("lo"), F.col("last_offset").alias("hi"))
        return covered_ranges(asked, done).count() == len(ranges)

    def _write(self, batch: DataFrame, batch_id: int, ranges: list) -> None:
        if self._covered(self.ledger.entries(), ranges):
            return
        rows = self.decode(batch) if self.decode else batch.drop("headers")
        changes = self.gate.admit(self.fields_of(rows), self.older) if self.gate is not None and self.fields_of else []
        for _ in range(self.retries):
            try:
                return self._commit(rows, changes, batch_id, ranges)
            except NumbersTaken:
                continue  # the files that were written are orphans; the rows get new numbers
        raise CommitConflict("other writers took the sequence numbers each time")

    def _commit(self, rows: DataFrame, changes: list[dict], batch_id: int, ranges: list) -> None:
        run = uuid.uuid4().hex
        out = f"{self.location.rstrip('/')}/data/{self.database}/{self.table}/{run}"
        bucket = "event_hour" if self.hourly else "event_date"
        base = self.ledger.next_lsn(self.database, self.table)
        numbered = number_rows(rows, base).withColumn(bucket, time_bucket(F.col("timestamp"), self.hourly)).withColumn("kafka_partition", F.col("partition"))
        # one shuffle brings a partition's day together; AQE splits a large one over several tasks
        dealt = numbered.hint("rebalance", bucket, "kafka_partition").sortWithinPartitions("read_lsn")
        dealt.write.option("compression", self.compression).option("parquet.block.row.count.limit", 131_072).option("maxRecordsPerFile", self.rows_per_file).partitionBy(bucket, "kafka_partition").parquet(out)
        files = self._files(out)
        snapshot = uuid.uuid4().int >> 65

        def entries(version: int) -> list[dict]:
            if self.ledger.next_lsn(self.database, self.table) != base:
                raise NumbersTaken
            name = f"{run}-{batch_id}"
            made = [{"type": "FlushBegun", "batch_id": name, "row_count": sum(f.row_count for f in files)}]
            made += [{"type": "FileCommitted", "database": self.database, "table": self.table, "snapshot_id": snapshot, "batch_id": name} | {k: f[k] for k in ("topic", "partition", "min_offset", "max_offset", "min_lsn", "read_lsn", "row_count", "file_path", "file_size_bytes")} for f in files]
            made += [{"type": "RangeCommitted", "table": self.table, "topic": r.topic, "partition": r.partition, "first_offset": r.lo, "last_offset": r.hi, "snapshot_id": snapshot} for r in ranges]
            return [*made, *({"database": self.database, "table": self.table} | c for c in changes), {"type": "FlushDone", "batch_id": name, "snapshot_id": snapshot}]

        Coordinator(self.ledger).commit(entries, done=lambda e: self._covered(e, ranges))
        self._since += len(files) + len(ranges) + len(changes) + 2
        if self._since >= self.checkpoint_entries or time.monotonic() - self._last >= self.checkpoint_s:
            self.ledger.checkpoint()
            self._since, self._last = 0, time.monotonic()

    def _files(self, out: str) -> list:
        """What each file of a batch holds, from the files themselves."""
        spark = self.ledger.spark
        meta = spark.read.parquet(out).select("topic", "partition", "offset", "read_lsn", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size_bytes"))
        per = meta.groupBy("file_path", "file_size_bytes", "topic", "partition").agg(F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"), F.min("read_lsn").alias("min_lsn"), F.max("read_lsn").alias("read_lsn"), F.count("*").alias("row_count"))
        return per.collect()  # a row a file

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Runs until stopped; without an interval, until what is there has been read."""
        writer = stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def eviction(states: DataFrame, limits: dict) -> DataFrame:
    """Decides for buffer states (``bytes``, ``rows``, ``age_s``, ``since_flush_s``) by limits, in order:
    size, rows, batch, age, interval."""
    choice = (
        F.when(F.col("bytes") >= limits["max_bytes"], "evict_immediate").when(F.col("rows") >= limits["max_rows"], "count").when(F.col("rows") >= limits["batch_rows"], "count")
        .when(F.col("age_s") >= limits["ttl_s"], "ttl").when(F.col("since_flush_s") >= limits["interval_s"], "interval").otherwise("none")
    )
    return states.withColumn("decision", choice)
