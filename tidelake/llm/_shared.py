"""What the operators share: the shared folder, tables that cut lineage, and the code on executors."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bits of a filter that every task holds, at most.
FILTER_BITS = 1 << 27
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder of this machine is set, in local mode only; elsewhere
    that is an error, since executors couldn't reach it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: the operators need a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path under this application's part of the shared folder, which goes when it ends."""
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    sc = spark.sparkContext
    if folder not in getattr(sc, "_tidelake_folders", ()):
        fs, at = _file_system(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        sc._tidelake_folders = {*getattr(sc, "_tidelake_folders", ()), folder}
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the lineage ends there, and the rows
    (generated keys included) stay the same whatever executor is lost later."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelake_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t._tidelake_path)
        fs.delete(at, True)


def bucketed(df: DataFrame, name: str, column: str, buckets: int, portions: int = 1) -> tuple[DataFrame, Callable[[], None]]:
    """Like ``written``, filed by hashes of a column: a join by it with at least so many buckets as there
    are shuffle partitions doesn't move the table, however often it is joined.  Also returns what
    deletes it.  Rows are moved in so many portions, a share of the buckets each, one after the other."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    called = "tidelake_" + path.rsplit("/", 1)[1].replace("-", "_")
    bucket = F.pmod(F.hash(column), F.lit(buckets))
    for i in range(portions):
        part = df if portions == 1 else df.filter(bucket % portions == i)
        part.repartition(buckets, column).write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).mode("append" if i else "error").saveAsTable(called)
        if i + 1 < portions:
            release(spark)
    out = spark.table(called)
    out._tidelake_path = path

    def drop() -> None:
        spark.sql(f"drop table if exists {called}")
        forget(out)

    return out, drop


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the unsigned keys' bits are set."""
    at = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap_of(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit is set for each of the column ``key``'s values; at most so many bits."""
    bits = min(bits, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    place = keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("p"))
    rows = place.groupBy(F.shiftright("p", 15).alias("at")).agg(F.expr("bitmap_construct_agg(p & 32767)").alias("bitmap")).collect()  # 4 kB each
    whole = np.zeros((bits >> 15, 4096), dtype=np.uint8)
    for r in rows:
        whole[r["at"]] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return whole.ravel()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does once the driver's memory
    is collected: a long chain of steps would keep them all."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which the worker gives free memory back to the system; workers
    are kept for later tasks, also those of other operators."""

    def run_and_trim(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc's
            libc.malloc_trim(0)

    return run_and_trim


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each Spark context, so that Python workers can
    import it wherever they run.  Where the session leaves the size of batches at Spark's default it
    is lowered, so that a worker holds few texts at a time however long they are."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "64m") in ("64m", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(_BATCH, "8m")
    if getattr(sc, "_tidelake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tidelake-"), "tidelake_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._tidelake_shipped = True
