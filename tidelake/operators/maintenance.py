"""Maintenance of a table: compaction, expiration, orphans and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.errors import StorageError
from tidelake.operators.ledger import Coordinator, Ledger, bare_path, pinned_files, protected_files, replaced_files

MIB = 1 << 20


def candidates(files: DataFrame, threshold: int) -> DataFrame:
    """Files smaller than the threshold."""
    return files.filter(F.col("size") < threshold)


def bins(files: DataFrame, target: int, group: list[str] | None = None) -> DataFrame:
    """files: ``file_id``, ``size``.  Adds ``bin``: by rising size, a new bin starts where the next file
    would take a bin that isn't empty past the target.  Bins of one file are left out.

    A fold over the sorted files of one table (or group), in Catalyst.  Files no larger than half the
    target come first, so sizes and ids of one group's files are all that a task holds."""
    keys = group or []
    one = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("size", "file_id"))).alias("xs"))
    kind = files.schema["file_id"].dataType.simpleString()
    start = f"named_struct('bin', 0L, 'cur', 0L, 'part', cast(array() as array<struct<file_id:{kind},size:bigint,bin:bigint>>), 'out', cast(array() as array<array<struct<file_id:{kind},size:bigint,bin:bigint>>>))"
    step = f"""(a, x) -> case when size(a.part) > 0 and a.cur + x.size > {target}
        then named_struct('bin', a.bin + 1, 'cur', x.size, 'part', array(named_struct('file_id', x.file_id, 'size', x.size, 'bin', a.bin + 1)), 'out', concat(a.out, array(a.part)))
        else named_struct('bin', a.bin, 'cur', a.cur + x.size, 'part', concat(a.part, array(named_struct('file_id', x.file_id, 'size', x.size, 'bin', a.bin))), 'out', a.out) end"""
    folded = one.select(*keys, F.expr(f"aggregate(xs, {start}, {step}, a -> flatten(filter(concat(a.out, array(a.part)), p -> size(p) > 1)))").alias("r"))
    return folded.select(*keys, F.explode("r").alias("f")).select(*keys, "f.file_id", "f.size", "f.bin")


def savings(files: DataFrame) -> DataFrame:
    """What compaction is expected to save: a twelfth of the bytes."""
    return files.agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.expr("sum(size) div 12").alias("saved"))


def compact(ledger: Ledger, database: str, table: str, location: str, threshold: int = 100 * MIB, target: int = 512 * MIB) -> int:
    """Merges small files of a partition and replaces them in one commit; returns how many went.  Rows
    keep their order by sequence number.  A commit that fails raises and leaves the table as it was."""
    spark, snapshot = ledger.spark, uuid.uuid4().int >> 65
    files = ledger.files().filter((F.col("database") == database) & (F.col("table") == table)).withColumnsRenamed({"file_path": "file_id", "file_size_bytes": "size"})
    packed = bins(candidates(files, threshold).select("topic", "partition", "file_id", "size"), target, ["topic", "partition"])
    meta = packed.join(files.select("file_id", "min_offset", "max_offset", "min_lsn", "read_lsn", "row_count"), "file_id")
    groups = meta.groupBy("topic", "partition", "bin").agg(
        F.sort_array(F.collect_list("file_id")).alias("paths"), F.min("min_offset").alias("min_offset"), F.max("max_offset").alias("max_offset"), F.min("min_lsn").alias("min_lsn"), F.max("read_lsn").alias("read_lsn"), F.sum("row_count").alias("row_count")
    )
    entries, gone = [], []
    for g in groups.collect():  # the files to merge, as the ledger lists them; rows stay on executors
        out = f"{location.rstrip('/')}/compacted/{uuid.uuid4().hex}"
        spark.read.option("mergeSchema", "true").parquet(*g.paths).coalesce(1).sortWithinPartitions("read_lsn").write.parquet(out)
        for path, size in list_files(spark, out).filter(F.col("path").endswith(".parquet")).select("path", "size").collect():
            entries.append({"type": "FileCommitted", "database": database, "table": table, "topic": g.topic, "partition": g.partition, "min_offset": g.min_offset, "max_offset": g.max_offset, "min_lsn": g.min_lsn, "read_lsn": g.read_lsn, "row_count": g.row_count, "file_path": path, "file_size_bytes": size, "snapshot_id": snapshot})
        gone += g.paths
    if gone:
        entries += [{"type": "FilesReplaced", "database": database, "table": table, "file_paths": gone, "snapshot_id": snapshot}, {"type": "Maintained", "operation": "compaction", "details": f"{len(gone)} files"}]
        live = set(gone)

        def make(version: int) -> list[dict]:
            still = {r.file_path for r in ledger.files().filter(F.col("file_path").isin(list(live))).select("file_path").collect()}
            if still != live:
                raise RuntimeError("files to replace have gone meanwhile")
            return entries

        Coordinator(ledger).commit(make)
    return len(gone)


def expired(snapshots: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """snapshots: ``snapshot_id``, ``timestamp``.  Those past retention, never the current one."""
    last = snapshots.agg(F.max_by("snapshot_id", F.struct("timestamp", "snapshot_id")).alias("current"))
    return snapshots.join(F.broadcast(last)).filter((F.col("snapshot_id") != F.col("current")) & (F.col("timestamp") < now_ms - retention_ms)).drop("current")


def expiration_impact(gone: DataFrame, files: DataFrame) -> DataFrame:
    """gone: ``snapshot_id`` of expired snapshots; files: ``snapshot_id``, ``file_path``, ``size``, ``live``.
    One row: ``snapshots``, their ``files`` and ``bytes`` that go, and ``kept_files`` that are live."""
    mine = files.join(gone.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    sums = mine.agg(F.count_if(~F.col("live")).alias("files"), F.coalesce(F.sum(F.when(~F.col("live"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("live")).alias("kept_files"))
    return gone.agg(F.count_distinct("snapshot_id").alias("snapshots")).join(sums)  # a row each


def expire(ledger: Ledger, database: str, table: str, now_ms: int, retention_ms: int, dry_run: bool = False) -> dict:
    """Expires a table's snapshots past retention: deletes those of their files that were replaced before
    the retention began and that no scan pins.  A snapshot is recorded as expired once.  Returns what
    ``expiration_impact`` says."""
    entries = ledger.entries()
    mine = (F.col("database") == database) & (F.col("table") == table)
    snapshots = entries.filter((F.col("type") == "FileCommitted") & mine).groupBy("snapshot_id").agg(F.max("timestamp").alias("timestamp"))
    before = entries.filter((F.col("type") == "SnapshotsExpired") & mine).select(F.explode("snapshot_ids").alias("snapshot_id"))
    old = expired(snapshots, now_ms, retention_ms)
    dead = replaced_files(entries).filter(mine & (F.col("replaced_at") < now_ms - retention_ms)).join(pinned_files(entries, now_ms), "file_path", "left_anti").select("file_path").withColumn("dead", F.lit(True))
    files = entries.filter((F.col("type") == "FileCommitted") & mine).join(dead, "file_path", "left")
    files = files.select("snapshot_id", "file_path", F.col("file_size_bytes").alias("size"), F.col("dead").isNull().alias("live"))
    new = old.join(before, "snapshot_id", "left_anti")
    impact = expiration_impact(new, files.join(old.select("snapshot_id"), "snapshot_id", "left_semi")).first().asDict()
    if not dry_run:
        ids = sorted(r.snapshot_id for r in new.select("snapshot_id").collect())  # a number a commit
        # files of snapshots that expired before may have been pinned then
        delete_files(ledger.spark, files.filter("not live").join(old, "snapshot_id", "left_semi").select(F.col("file_path").alias("path")))
        if ids:
            Coordinator(ledger).commit(lambda v: [{"type": "SnapshotsExpired", "database": database, "table": table, "snapshot_ids": ids}, {"type": "Maintained", "operation": "expire", "details": f"{impact['files']} files"}])
    return impact


def clean_orphans(ledger: Ledger, folder: str, now_ms: int, retention_ms: int, dry_run: bool = False) -> int:
    """Deletes old files below a folder that nothing protects; returns how many there were.  Refuses
    where the retention is so short that a commit under way could lose files."""
    listed = list_files(ledger.spark, folder)
    found = orphans(listed, protected_files(ledger.entries(), now_ms, retention_ms), now_ms - retention_ms)
    if dry_run:
        return found.count()
    if not retention_is_safe(listed, now_ms, retention_ms):
        raise StorageError("the retention is under a day and files of the last hour are there")
    return delete_files(ledger.spark, found)


def snapshot_id_of(path):
    """The snapshot's number in the name of its manifest list."""
    return F.regexp_extract(path, r"snap-(\d+)", 1).try_cast("long")


def file_class(path):
    """What a file of a table is, by its name."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name.endswith(".parquet"), "data").when(name.rlike(r"^snap-.*\.avro$"), "manifest_list").when(name.rlike(r"manifest.*\.avro$"), "manifest")
        .when(path.contains("/statistics"), "statistics").otherwise("unknown")
    )


def orphans(listed: DataFrame, referenced: DataFrame, cutoff_ms: int) -> DataFrame:
    """listed: ``path``, ``size``, ``mtime``; referenced: ``path``.  Old files that nothing refers to."""
    named = referenced.select(bare_path(F.col("path")).alias("_bare")).distinct()
    return listed.filter(F.col("mtime") < cutoff_ms).withColumn("_bare", bare_path(F.col("path"))).join(named, "_bare", "left_anti").drop("_bare").withColumn("class", file_class(F.col("path")))


def orphan_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("class").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def retention_is_safe(listed: DataFrame, now_ms: int, retention_ms: int) -> bool:
    """Whether no file of the last hour is in danger: retention is a day, or none is that new."""
    if retention_ms >= 86_400_000:
        return True
    return listed.filter(F.col("mtime") > now_ms - 3_600_000).isEmpty()


def delete_files(spark: SparkSession, paths: DataFrame) -> int:
    """Deletes files by name on the driver, one small request each; returns how many were there."""
    n = 0
    for r in paths.select("path").toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False))
    return n


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``size``, ``mtime`` of all files below a folder, listed by executors' readers."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def column_stats(rows: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """``column``, ``min``, ``max`` (as text), ``nulls``, ``distinct`` of each column, in one pass."""
    names = columns or [f.name for f in rows.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    count = F.count_distinct if exact else F.approx_count_distinct
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}"), count(c).alias(f"d{i}")]
    one = rows.agg(*aggs)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(names)))
    return one.select(F.inline(each))


def field_numbers(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing: ``id``, ``name``; new: ``name``, ``place``.  New fields get the ids after the largest."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    nth = F.row_number().over(Window.orderBy("place"))  # fields of one schema
    return existing.select("id", "name").unionByName(new.join(F.broadcast(top)).select((F.col("top") + nth).cast("int").alias("id"), "name"))
