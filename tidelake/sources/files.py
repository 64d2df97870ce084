"""Existing Parquet files as part of a table: inspection and registration without rewriting."""

from __future__ import annotations

import glob
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.errors import SchemaError, StorageError
from tidelake.operators.ledger import Coordinator, Ledger
from tidelake.operators.maintenance import list_files


def expand(sources: list[str]) -> list[str]:
    """Files of names, folders and patterns, in order, each once."""
    out = set()
    for s in sources:
        if os.path.isdir(s):
            out |= set(glob.glob(os.path.join(s, "**", "*.parquet"), recursive=True))
        else:
            out |= set(glob.glob(s)) if glob.has_magic(s) else {s}
    if not out:
        raise StorageError("no files")
    return sorted(out)


def inspect(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path``, ``size``, ``rows`` of Parquet files, counted by the readers from footers."""
    meta = spark.read.parquet(*paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    found = meta.groupBy("path", "size").agg(F.count("*").alias("rows"))
    # files without rows have no row to count
    listed = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return listed.withColumn("path", same(F.col("path"))).join(found.select(same(F.col("path")).alias("path"), "rows"), "path", "left").select("path", "size", F.coalesce("rows", F.lit(0)).alias("rows"))


def check_schemas(spark: SparkSession, paths: list[str]) -> None:
    """All files have the same columns: names, types, nullability and order."""
    first = spark.read.parquet(paths[0]).schema
    for p in paths[1:]:
        if (other := spark.read.parquet(p).schema) != first:
            raise SchemaError(f"{p} has {other.simpleString()}, not {first.simpleString()}")


def register_parquet(ledger: Ledger, database: str, table: str, sources: list[str]) -> int:
    """Makes files part of a table in one commit: each gets as many sequence numbers as it has rows (one
    at least), topic ``__backfill__``, and its place as offset.  Returns how many were registered."""
    paths = expand(sources)
    check_schemas(ledger.spark, paths)
    rows = inspect(ledger.spark, paths).orderBy("path").collect()  # one for each file
    snapshot = uuid.uuid4().int >> 65

    def entries(version: int) -> list[dict]:
        lsn, out = ledger.next_lsn(database, table), []
        for i, r in enumerate(rows):
            n = max(r.rows, 1)
            out.append({"type": "FileCommitted", "database": database, "table": table, "topic": "__backfill__", "partition": 0, "min_offset": i, "max_offset": i, "min_lsn": lsn, "read_lsn": lsn + n - 1, "row_count": r.rows, "file_path": r.path, "file_size_bytes": r.size, "snapshot_id": snapshot})
            lsn += n
        return [*out, {"type": "Maintained", "operation": "backfill-register", "details": f"{len(rows)} files"}]

    Coordinator(ledger).commit(entries)
    return len(rows)


def reset_table(ledger: Ledger, database: str, table: str) -> None:
    """Forgets a table's files; the files stay."""
    Coordinator(ledger).commit(lambda v: [{"type": "TableCleared", "database": database, "table": table, "keep_data": True}])


__all__ = ["check_schemas", "expand", "inspect", "list_files", "register_parquet", "reset_table"]
