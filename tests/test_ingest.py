"""From messages to typed rows by configuration, and maintenance that loses nothing that is needed."""

import time

import pytest
from pyspark.sql import functions as F

from tidelake import config
from tidelake.errors import SchemaError, StorageError
from tidelake.operators import maintenance, proto, snapshot
from tidelake.operators.ledger import Ledger, pinned_files
from tidelake.sources import files, log
from tidelake.sources.registry import InMemoryRegistry
from tidelake.streaming import ingest
from tidelake.streaming.service import Tables
from tidelake.streaming.sink import Sink

DAY = 86_400_000
FIRST = "message Parcel { string owner = 1; int32 shelf = 2; }"
SECOND = "message Parcel { string owner = 1; int32 shelf = 2; int64 grams = 3; }"


def settings(tmp_path, kind, **evolution):
    c = config.Config()
    c.kafka.topic, c.kafka.format.type, c.table.warehouse_path, c.table.table_name, c.ledger.log_dir = "t", kind, str(tmp_path / "table"), "parcels", str(tmp_path / "ledger")
    c.schema_evolution = config.Evolution(**evolution)
    return c


def send(spark, tmp_path, values):
    log.append(str(tmp_path / "log"), "t", 0, [{"key": None, "value": v, "timestamp": 1_700_000_000_000} for v in values])
    return log.read_log(spark, str(tmp_path / "log"), "t").orderBy("offset").filter(F.col("offset") >= send.at.get(str(tmp_path), 0))


send.at = {}


def sent(tmp_path, n):
    send.at[str(tmp_path)] = send.at.get(str(tmp_path), 0) + n


def test_protobuf_through_a_schema_change(spark, tmp_path):
    c, led, registry = settings(tmp_path, "protobuf"), Ledger(spark, str(tmp_path / "ledger")), InMemoryRegistry()
    one = registry.register("t-value", FIRST).id
    sink = ingest.build(led, c, registry)
    body = b"\x0a\x03Ada\x10\x07"
    sink.write_batch(send(spark, tmp_path, [proto.frame(one, body)] * 3), 0)
    sent(tmp_path, 3)
    two = registry.register("t-value", SECOND).id
    sink = ingest.build(led, c, registry)  # a restart finds the newer version
    sink.write_batch(send(spark, tmp_path, [proto.frame(one, body), proto.frame(two, body + b"\x18\x09")]), 1)
    assert [f.name for f in ingest.table_schema(led, "default", "parcels").fields] == ["owner", "shelf", "grams"]
    got = snapshot.Snapshot(spark, led.files()).read().orderBy("read_lsn").collect()
    assert [(r.owner, r.shelf, r.grams) for r in got] == [("Ada", 7, None)] * 4 + [("Ada", 7, 9)] and [r.read_lsn for r in got] == [1, 2, 3, 4, 5]
    assert snapshot.Snapshot(spark, led.files(), lsn=3).read().count() == 3
    # a field that changes its type pauses the table at the start
    registry.register("t-value", SECOND.replace("int64 grams", "string grams"))
    with pytest.raises(SchemaError, match="changed type"):
        ingest.build(led, c, registry)


def test_typed_json(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    sink = ingest.build(led, settings(tmp_path, "json"))
    sink.write_batch(send(spark, tmp_path, [b'{"a":1,"b":"x"}', b'{"a":2}', None]), 0)
    sent(tmp_path, 3)
    sink = ingest.build(led, settings(tmp_path, "json"))
    sink.write_batch(send(spark, tmp_path, [b'{"a":5,"c":1.5}']), 1)
    sent(tmp_path, 1)
    got = snapshot.Snapshot(spark, led.files()).read().orderBy("read_lsn").collect()
    assert [(r.a, r.b, r.c) for r in got] == [(1, "x", None), (2, None, None), (None, None, None), (5, None, 1.5)]
    with pytest.raises(SchemaError, match="changed type"):
        sink.write_batch(send(spark, tmp_path, [b'{"a":"text"}']), 2)
    assert sink.gate.paused and led.files().agg(F.sum("row_count")).first()[0] == 4


def test_manual_evolution_stops_new_fields(spark, tmp_path):
    led, c, registry = Ledger(spark, str(tmp_path / "ledger")), settings(tmp_path, "protobuf", mode="manual"), InMemoryRegistry()
    registry.register("t-value", FIRST)
    assert not ingest.build(led, c, registry).gate.paused  # a new table takes its first fields
    registry.register("t-value", SECOND)
    with pytest.raises(SchemaError, match="new fields"):
        ingest.build(led, c, registry)


def test_checkpoints_by_entries(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    Sink(led, str(tmp_path / "table"), table="parcels", checkpoint_entries=1).write_batch(send(spark, tmp_path, [b"x"]), 0)
    assert led._checkpointed() == 0 and led.files().count() == 1


def test_numbers_taken_meanwhile(spark, tmp_path):
    """A writer that comes second gets later numbers."""
    led = Ledger(spark, str(tmp_path / "ledger"))
    sink, plain, calls = Sink(led, str(tmp_path / "table"), table="parcels"), led.next_lsn, []

    def next_lsn(database, table):
        calls.append(1)
        if len(calls) == 2:  # between the first one's numbering and its commit
            led.append([{"type": "FileCommitted", "database": database, "table": table, "topic": "other", "partition": 0, "min_offset": 0, "max_offset": 9, "min_lsn": 1, "read_lsn": 10, "row_count": 10, "file_path": "x", "snapshot_id": 1}])
        return plain(database, table)

    led.next_lsn = next_lsn
    sink.write_batch(send(spark, tmp_path, [b"x", b"y"]), 0)
    assert [(r.min_lsn, r.read_lsn) for r in led.files().filter("topic = 't'").collect()] == [(11, 12)]


def test_cleaning_keeps_what_is_needed(spark, tmp_path):
    led, folder = Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "table")
    sink = Sink(led, folder, table="parcels")
    for i in range(2):
        sink.write_batch(send(spark, tmp_path, [b"x"] * 3), i)
        sent(tmp_path, 3)
    later = int(time.time() * 1000) + 10 * DAY
    spark.range(1).coalesce(1).write.parquet(f"{folder}/data/default/parcels/lost")  # no entry names it
    assert maintenance.clean_orphans(led, f"{folder}/data", later, DAY, dry_run=True) == 1
    assert maintenance.clean_orphans(led, f"{folder}/data", later, DAY) == 1 and led.files().count() == 2
    scan, rows = Tables(led, lease_s=30 * 86_400).begin("default", "parcels")
    assert maintenance.compact(led, "default", "parcels", folder) == 2 and led.files().count() == 1
    # replaced files go once the retention is over and no scan holds them
    assert maintenance.expire(led, "default", "parcels", later, DAY)["files"] == 0 and rows.count() == 6
    assert pinned_files(led.entries(), later).count() == 2
    led.append([{"type": "FilesReleased", "batch_id": scan}])
    maintenance.expire(led, "default", "parcels", later, DAY)
    assert [r.path for r in maintenance.list_files(spark, f"{folder}/data").collect() if r.path.endswith(".parquet")] == []
    assert snapshot.Snapshot(spark, led.files()).read().count() == 6
    assert maintenance.expire(led, "default", "parcels", later, DAY)["snapshots"] == 0  # each once
    # a table that was cleared to keep its data keeps it
    files.reset_table(led, "default", "parcels")
    maintenance.clean_orphans(led, f"{folder}/compacted", later, DAY)
    assert any(r.path.endswith(".parquet") for r in maintenance.list_files(spark, f"{folder}/compacted").collect())
    with pytest.raises(StorageError):
        maintenance.clean_orphans(led, f"{folder}/compacted", int(time.time() * 1000), 1000)
