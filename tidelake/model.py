"""Schemas of the message log, the ledger and the table's files."""

from __future__ import annotations

from pyspark.sql import types as T

#: A message as a source gives it.
MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("timestamp", T.LongType(), False),  # ms since the epoch
        T.StructField("headers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))),
    ]
)
#: A raw table's columns: messages without headers, with the log sequence number.
RAW = T.StructType([*MESSAGE.fields[:-1], T.StructField("read_lsn", T.LongType(), False)])
METADATA = ("key", "value", "topic", "partition", "offset", "timestamp", "read_lsn", "_schema_id", "_message_type")

#: An entry of the ledger: where it stands, what it says, and what it says it about.
LEDGER = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.LongType()),  # ms since the epoch
        # the table, and the flush or maintenance that made the entry
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("snapshot_id", T.LongType()),
        # a file, and the rows in it
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("min_offset", T.LongType()),
        T.StructField("max_offset", T.LongType()),
        T.StructField("min_lsn", T.LongType()),
        T.StructField("read_lsn", T.LongType()),
        # a range of offsets that is committed whole
        T.StructField("first_offset", T.LongType()),
        T.StructField("last_offset", T.LongType()),
        # several files or snapshots at once; until when files are pinned
        T.StructField("file_paths", T.ArrayType(T.StringType())),
        T.StructField("snapshot_ids", T.ArrayType(T.LongType())),
        T.StructField("until", T.LongType()),
        T.StructField("keep_data", T.BooleanType()),
        # a change of the table's schema
        T.StructField("schema_before", T.LongType()),
        T.StructField("schema_after", T.LongType()),
        T.StructField("fields_added", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "doc")]))),
    ]
)
#: What an entry may say.
ENTRY_TYPES = (
    "FlushBegun", "FileWritten", "SnapshotMade", "FlushDone", "FileCommitted", "RangeCommitted", "TableCleared", "SchemaChanged", "FilesReplaced", "FilesPinned", "FilesReleased",
    "SnapshotsExpired", "Maintained",
)
#: A committed file of the table.
DATA_FILE = "file_path string, topic string, partition int, event_date string, min_offset long, max_offset long, min_lsn long, read_lsn long, row_count long, file_size_bytes long, snapshot_id long"
