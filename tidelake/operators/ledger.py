"""The ledger: an append-only table of entries in version files, and the commit protocol on it.

A version is one file of JSON lines that is created if and only if it isn't there yet; that creation
is the compare-and-swap.  Readers see versions 0, 1, … without gaps.  A checkpoint rewrites all
entries up to a version as Parquet; nothing visible is lost by it.  Entries are a DataFrame, so
recovery, watermarks and file lists are queries.
"""

from __future__ import annotations

import json
import os
import random
import sqlite3
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import closing
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.errors import CommitConflict, LedgerError
from tidelake.model import ENTRY_TYPES, LEDGER

#: Versions that one file can hold entries of: seq = version * STEP + place.
STEP = 1_000_000


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        """The last version, -1 for a new ledger."""
        names = [n for n in self._names("versions") if n.endswith(".jsonl")]
        return int(names[-1].split(".")[0]) if names else self._checkpointed()

    def _checkpointed(self) -> int:
        done = [int(n.removeprefix("upto-")) for n in self._names("checkpoints") if n.startswith("upto-") and self._fs(f"{self.path}/checkpoints/{n}/_SUCCESS")[0].exists(self._fs(f"{self.path}/checkpoints/{n}/_SUCCESS")[1])]
        return max(done, default=-1)

    def append(self, entries: Iterable[dict], expected: int | None = None) -> int:
        """Commits entries as the version after ``expected`` (None: the last); raises CommitConflict
        if that version is there already.  Returns the new version."""
        version = (self.version() if expected is None else expected) + 1
        rows = list(entries)
        for e in rows:
            if e.get("type") not in ENTRY_TYPES:
                raise LedgerError(f"no such type of entry: {e.get('type')}")
            if unknown := set(e) - set(LEDGER.fieldNames()):
                raise LedgerError(f"no such fields: {sorted(unknown)}")
        now = int(time.time() * 1000)
        text = "".join(json.dumps({"timestamp": now} | e | {"seq": version * STEP + i}, separators=(",", ":")) + "\n" for i, e in enumerate(rows))
        self._create(f"{self.path}/versions/{version:012d}.jsonl", text.encode())
        return version

    def _create(self, path: str, data: bytes) -> None:
        """Writes a file that must be new, whole or not at all."""
        url = urlparse(path)
        if url.scheme in ("", "file"):
            os.makedirs(os.path.dirname(url.path), exist_ok=True)
            tmp = f"{os.path.dirname(url.path)}/.{uuid.uuid4().hex}"
            with open(tmp, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(tmp, url.path)  # fails if another writer was first
            except FileExistsError as e:
                raise CommitConflict(path) from e
            finally:
                os.unlink(tmp)
            return
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise CommitConflict(path) from e
            raise
        out.write(bytearray(data))
        out.close()

    def entries(self) -> DataFrame:
        """All entries, each with its ``seq``; a line that isn't an entry raises when it is read."""
        upto = self._checkpointed()
        names = [n for n in self._names("versions") if n.endswith(".jsonl") and int(n.split(".")[0]) > upto]
        parts = []
        if upto >= 0:
            parts.append(self.spark.read.schema(LEDGER).parquet(f"{self.path}/checkpoints/upto-{upto}"))
        if names:
            parts.append(self.spark.read.schema(LEDGER).option("mode", "FAILFAST").json([f"{self.path}/versions/{n}" for n in names]))
        if not parts:
            return self.spark.createDataFrame([], LEDGER)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def checkpoint(self, keep: int = 2) -> int:
        """Rewrites the entries so far as Parquet and drops version files and checkpoints that it
        makes redundant, but for the last ``keep`` versions."""
        version = self.version()
        if version > self._checkpointed():
            self.entries().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/checkpoints/upto-{version}")
        for n in self._names("checkpoints"):
            if n.startswith("upto-") and int(n.removeprefix("upto-")) < version:
                fs, p = self._fs(f"{self.path}/checkpoints/{n}")
                fs.delete(p, True)
        for n in self._names("versions"):
            if n.endswith(".jsonl") and int(n.split(".")[0]) <= version - keep:
                fs, p = self._fs(f"{self.path}/versions/{n}")
                fs.delete(p, False)
        return version

    def files(self) -> DataFrame:
        """Files that are visible: committed after their table's last reset and not replaced."""
        return live_files(self.entries())

    def next_lsn(self, database: str, table: str) -> int:
        mine = self.entries().filter((F.col("type") == "FileCommitted") & (F.col("database") == database) & (F.col("table") == table))
        return (mine.agg(F.max("read_lsn")).first()[0] or 0) + 1


def bare_path(path):
    """A path as it compares: readers write local ones with one slash after the scheme or three."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^//+", "/")


def pinned_files(entries: DataFrame, now_ms: int) -> DataFrame:
    """``file_path`` of files that a scan holds: pinned until later, and not released."""
    released = entries.filter("type = 'FilesReleased'").select("batch_id")
    pins = entries.filter((F.col("type") == "FilesPinned") & (F.col("until") > now_ms)).join(released, "batch_id", "left_anti")
    return pins.select(F.explode("file_paths").alias("file_path")).distinct()


def replaced_files(entries: DataFrame) -> DataFrame:
    """Committed files that a later entry replaced, with the time of that (``replaced_at``)."""
    gone = entries.filter("type = 'FilesReplaced'").select(F.explode("file_paths").alias("file_path"), "timestamp").groupBy("file_path").agg(F.max("timestamp").alias("replaced_at"))
    return entries.filter("type = 'FileCommitted'").join(gone, "file_path")


def kept_files(entries: DataFrame) -> DataFrame:
    """Files that their table forgot when it was cleared, if that was to keep the data."""
    files = entries.filter("type = 'FileCommitted'").select("database", "table", "file_path", "seq")
    cleared = entries.filter("type = 'TableCleared'").select("database", "table", F.col("seq").alias("cleared"), F.coalesce("keep_data", F.lit(False)).alias("kept"))
    first = files.join(cleared, ["database", "table"]).filter("seq < cleared").groupBy("file_path").agg(F.min_by("kept", "cleared").alias("kept"))
    return first.filter("kept").select("file_path")


def protected_files(entries: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """``path`` of what cleaning up has to leave alone: live files, files of a cleared table that were
    to be kept, files that a scan pins, and files that were replaced within the retention."""
    recent = replaced_files(entries).filter(F.col("replaced_at") >= now_ms - retention_ms)
    parts = [live_files(entries), kept_files(entries), pinned_files(entries, now_ms), recent]
    out = parts[0].select("file_path")
    for p in parts[1:]:
        out = out.unionByName(p.select("file_path"))
    return out.select(F.col("file_path").alias("path")).distinct()


def live_files(entries: DataFrame) -> DataFrame:
    """Committed files after their table's last reset, without those that a later entry replaced."""
    reset = entries.filter("type = 'TableCleared'").groupBy("database", "table").agg(F.max("seq").alias("reset"))
    gone = entries.filter("type = 'FilesReplaced'").select(F.explode("file_paths").alias("file_path")).distinct()
    files = entries.filter("type = 'FileCommitted'").join(reset, ["database", "table"], "left")
    files = files.filter(F.col("reset").isNull() | (F.col("seq") > F.col("reset"))).drop("reset")
    return files.join(gone, "file_path", "left_anti")


class Coordinator:
    """Commits with idempotency by offset range and with retries on conflicts."""

    def __init__(self, ledger: Ledger, retries: int = 3, base_ms: int = 100, most_ms: int = 10_000, sleep: Callable[[float], None] = time.sleep):
        self.ledger, self.retries, self.base_ms, self.most_ms, self.sleep = ledger, retries, base_ms, most_ms, sleep
        self.attempted = self.succeeded = self.conflicts = 0

    def covered(self, topic: str, partition: int, lo: int, hi: int) -> bool:
        """Whether a committed range holds these offsets."""
        e = self.ledger.entries().filter((F.col("type") == "RangeCommitted") & (F.col("topic") == topic) & (F.col("partition") == partition))
        return not e.filter((F.col("first_offset") <= lo) & (F.col("last_offset") >= hi)).isEmpty()

    def commit(self, entries: Callable[[int], list[dict]], done: Callable[[DataFrame], bool] | None = None) -> int | None:
        """Appends what ``entries`` makes of the version to come.  done: asked before each try whether
        the ledger has these entries already; then nothing is written and None is returned."""
        self.attempted += 1
        for attempt in range(self.retries + 1):
            version = self.ledger.version()
            if done is not None and done(self.ledger.entries()):
                return None
            try:
                self.ledger.append(entries(version + 1), version)
                self.succeeded += 1
                return version + 1
            except CommitConflict:
                self.conflicts += 1
                if attempt == self.retries:
                    raise
                wait = min(self.most_ms, self.base_ms * 2**attempt)
                self.sleep(wait * random.uniform(0.75, 1.25) / 1000)
        return None

    def success_rate(self) -> float:
        return self.succeeded / self.attempted if self.attempted else 1.0


class SqlCatalog:
    """Tables and their versions in SQLite.  A table's row holds where it is, its schema and its current
    version; a version is a document that lists all its files, so a commit inserts one and moves the
    table to it, in one transaction and only from the version that the writer saw."""

    def __init__(self, path: str, catalog: str = "default"):
        self.path, self.catalog = path, catalog
        with closing(self._open()) as c, c:
            c.execute("create table if not exists lake_space(catalog text, space text, settings text, primary key(catalog, space))")
            c.execute("create table if not exists lake_table(place integer primary key, catalog text, space text, name text, root text, shape text, shape_no integer default 0, at integer, unique(catalog, space, name))")
            c.execute("create table if not exists lake_version(place integer references lake_table, version integer, listing text, primary key(place, version))")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path, timeout=30)

    def create_namespace(self, namespace: str, properties: dict | None = None) -> None:
        with closing(self._open()) as c, c:
            c.execute("insert or ignore into lake_space values (?, ?, ?)", (self.catalog, namespace, json.dumps(properties or {})))

    def namespaces(self) -> list[str]:
        with closing(self._open()) as c:
            return [r[0] for r in c.execute("select space from lake_space where catalog = ? order by 1", (self.catalog,))]

    def create_table(self, namespace: str, table: str, location: str, schema_json: str) -> None:
        self.create_namespace(namespace)
        with closing(self._open()) as c, c:
            c.execute("insert or ignore into lake_table(catalog, space, name, root, shape) values (?, ?, ?, ?, ?)", (self.catalog, namespace, table, location, schema_json))

    def tables(self, namespace: str) -> list[str]:
        with closing(self._open()) as c:
            return [r[0] for r in c.execute("select name from lake_table where catalog = ? and space = ? order by 1", (self.catalog, namespace))]

    def _row(self, c: sqlite3.Connection, namespace: str, table: str) -> tuple | None:
        return c.execute("select place, root, at, shape_no, shape from lake_table where catalog = ? and space = ? and name = ?", (self.catalog, namespace, table)).fetchone()

    def _listing(self, c: sqlite3.Connection, place: int, version: int | None) -> list[dict]:
        r = c.execute("select listing from lake_version where place = ? and version = ?", (place, version)).fetchone()
        return json.loads(r[0]) if r else []

    def load(self, namespace: str, table: str) -> dict | None:
        with closing(self._open()) as c:
            r = self._row(c, namespace, table)
        return dict(zip(("location", "snapshot_id", "schema_id", "schema_json"), r[1:], strict=True)) if r else None

    def commit(self, namespace: str, table: str, expected: int | None, snapshot_id: int, added: list[dict], removed: list[str] = ()) -> None:
        """Makes the version ``snapshot_id`` of the current one and the files, if that is still ``expected``."""
        with closing(self._open()) as c, c:
            c.execute("begin immediate")
            r = self._row(c, namespace, table)
            if r is None or r[2] != expected:
                raise CommitConflict(f"{namespace}.{table} isn't at {expected}")
            gone = set(removed)
            listing = [f for f in self._listing(c, r[0], expected) if f["file_path"] not in gone]
            listing += [{"file_path": f["file_path"], "file_size_bytes": f["file_size_bytes"], "record_count": f["record_count"], "snapshot_id": snapshot_id} for f in added]
            c.execute("insert into lake_version values (?, ?, ?)", (r[0], snapshot_id, json.dumps(listing)))
            c.execute("update lake_table set at = ? where place = ?", (snapshot_id, r[0]))

    def update_schema(self, namespace: str, table: str, expected_id: int, schema_json: str) -> int:
        with closing(self._open()) as c, c:
            c.execute("begin immediate")
            r = self._row(c, namespace, table)
            if r is None or r[3] != expected_id:
                raise CommitConflict(f"{namespace}.{table}'s schema isn't {expected_id}")
            c.execute("update lake_table set shape = ?, shape_no = ? where place = ?", (schema_json, expected_id + 1, r[0]))
        return expected_id + 1

    def files(self, namespace: str, table: str) -> list[dict]:
        """The current version's files, oldest first."""
        with closing(self._open()) as c:
            r = self._row(c, namespace, table)
            return self._listing(c, r[0], r[2]) if r else []

    def reset(self, namespace: str, table: str) -> None:
        """Takes the table to no version at all; files and earlier versions stay."""
        with closing(self._open()) as c, c:
            c.execute("update lake_table set at = null where catalog = ? and space = ? and name = ?", (self.catalog, namespace, table))
