"""Ledger, sink, recovery, maintenance and reads, end to end on small logs."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tidelake.errors import CommitConflict, LedgerError, ReadStateError, SchemaError
from tidelake.operators import maintenance, recovery, snapshot
from tidelake.operators.health import CircuitBreaker, Health, TtlCache, prometheus
from tidelake.operators.ledger import Coordinator, Ledger, SqlCatalog
from tidelake.operators.schema import Field, TableSchema
from tidelake.sources import files, log
from tidelake.streaming.service import Tables, serve, to_ipc
from tidelake.streaming.sink import Gate, Sink, eviction, number_rows


def messages(n, first=0):
    return [{"key": f"key-{i}".encode(), "value": f"value-{i}".encode(), "timestamp": 1_700_000_000_000 + i} for i in range(first, first + n)]


def test_ledger_compare_and_swap(spark, tmp_path):
    led = Ledger(spark, str(tmp_path))
    assert led.version() == -1 and led.entries().count() == 0
    assert led.append([{"type": "FlushBegun", "batch_id": "a", "row_count": 1}]) == 0
    with pytest.raises(CommitConflict):
        led.append([{"type": "FlushBegun", "batch_id": "b"}], expected=-1)
    with pytest.raises(LedgerError):
        led.append([{"type": "Nothing"}])
    with pytest.raises(LedgerError):
        led.append([{"type": "FlushBegun", "colour": "red"}])
    won = []

    def race():
        try:
            won.append(led.append([{"type": "Maintained", "operation": "x"}], expected=0))
        except CommitConflict:
            pass

    threads = [threading.Thread(target=race) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert won == [1]
    assert led.checkpoint() == 1 and led.entries().count() == 2
    led.append([{"type": "Maintained", "operation": "y"}])
    assert [r.seq for r in led.entries().orderBy("seq").select("seq").collect()] == [0, 1_000_000, 2_000_000]


def test_malformed_ledger_line_raises(spark, tmp_path):
    led = Ledger(spark, str(tmp_path))
    led.append([{"type": "Maintained", "operation": "x"}])
    (tmp_path / "versions" / "000000000001.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        led.entries().collect()


def test_coordinator_retries(spark, tmp_path):
    led, waits = Ledger(spark, str(tmp_path)), []
    c = Coordinator(led, sleep=waits.append)
    calls = []

    def entries(version):
        if not calls:
            led.append([{"type": "Maintained", "operation": "other writer"}])
        calls.append(version)
        return [{"type": "Maintained", "operation": "mine"}]

    assert c.commit(entries) == 1 and calls == [0, 1] and len(waits) == 1 and c.success_rate() == 1.0
    assert c.commit(entries, done=lambda e: True) is None


def test_stream_to_table_and_back(spark, tmp_path):
    folder, led = str(tmp_path / "log"), Ledger(spark, str(tmp_path / "ledger"))
    for p in range(3):
        log.append(folder, "events", p, messages(10 + p))
    sink = Sink(led, str(tmp_path / "table"))
    sink.start(log.stream_log(spark, folder, "events"), str(tmp_path / "cp")).awaitTermination()
    rows = snapshot.Snapshot(spark, led.files()).read()
    assert rows.count() == 33
    assert sorted(r.read_lsn for r in rows.select("read_lsn").collect()) == list(range(1, 34))
    # more messages, a restart from the checkpoint, and a replay without it
    log.append(folder, "events", 1, messages(5, 11))
    sink.start(log.stream_log(spark, folder, "events"), str(tmp_path / "cp")).awaitTermination()
    assert snapshot.Snapshot(spark, led.files()).read().count() == 38
    sink.start(log.stream_log(spark, folder, "events"), str(tmp_path / "cp2")).awaitTermination()
    marks = {r.partition: r.committed_offset for r in snapshot.watermarks(led.files(), "max_offset").collect()}
    assert marks == {0: 9, 1: 15, 2: 11}
    # as of: rows up to a number, from files that overlap it
    assert snapshot.Snapshot(spark, led.files(), lsn=5).read().count() == 5
    with pytest.raises(ReadStateError, match="ahead"):
        snapshot.Snapshot(spark, led.files(), lsn=10_000).read()
    # the hot tail: what isn't committed yet
    log.append(folder, "events", 0, messages(4, 10))
    hot = snapshot.hot_tail(log.read_log(spark, folder, "events"), snapshot.watermarks(led.files(), "max_offset"))
    assert sorted(r.offset for r in hot.select("offset").collect()) == [10, 11, 12, 13]


def test_replayed_batch_commits_once(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    log.append(str(tmp_path / "log"), "t", 0, messages(6))
    batch = log.read_log(spark, str(tmp_path / "log"), "t")
    sink = Sink(led, str(tmp_path / "table"))
    sink.write_batch(batch, 0)
    sink.write_batch(batch, 0)
    assert snapshot.Snapshot(spark, led.files()).read().count() == 6 and led.version() == 0
    s = recovery.summary(led.entries()).first()
    assert (s.flushes_started, s.flushes_completed, s.rows, s.last_lsn) == (1, 1, 6, 6)
    starts = recovery.starting_offsets(led.entries()).collect()
    assert [(r.partition, r.start_offset) for r in starts] == [(0, 6)]


def test_numbers_follow_offsets(spark):
    rows = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in (5, 70_000, 6)], "topic string, partition int, offset long")
    got = [(r.partition, r.offset, r.read_lsn) for r in number_rows(rows, 10).orderBy("read_lsn").collect()]
    assert got == [(0, 5, 10), (0, 6, 11), (0, 70_000, 12), (1, 5, 13), (1, 6, 14), (1, 70_000, 15)]


def test_compaction_keeps_rows(spark, tmp_path):
    led, sink = Ledger(spark, str(tmp_path / "ledger")), None
    for i in range(4):
        log.append(str(tmp_path / "log"), "t", 0, messages(5, 5 * i))
    sink = Sink(led, str(tmp_path / "table"), table="t")
    sink.start(log.stream_log(spark, str(tmp_path / "log"), "t", most=5), str(tmp_path / "cp")).awaitTermination()
    for i in range(3):
        log.append(str(tmp_path / "log"), "t", 0, messages(5, 20 + 5 * i))
        sink.start(log.stream_log(spark, str(tmp_path / "log"), "t"), str(tmp_path / "cp")).awaitTermination()
    before = led.files().count()
    n = maintenance.compact(led, "default", "t", str(tmp_path / "table"))
    assert n == before and led.files().count() == 1
    rows = snapshot.Snapshot(spark, led.files()).read()
    assert sorted(r.offset for r in rows.select("offset").collect()) == list(range(35))
    listed = maintenance.list_files(spark, str(tmp_path / "table")).filter(F.col("path").endswith(".parquet"))
    orphans = maintenance.orphans(listed, led.files().select(F.col("file_path").alias("path")), 1 << 60)
    assert orphans.count() == n and maintenance.delete_files(spark, orphans) == n
    assert snapshot.Snapshot(spark, led.files()).read().count() == 35
    assert maintenance.compact(led, "default", "t", str(tmp_path / "table")) == 0  # one file is no group


def test_bins_restart_their_sum(spark):
    sizes = [3, 3, 3, 5, 6, 9, 20]
    df = spark.createDataFrame(list(enumerate(sizes)), "file_id int, size long")
    got = {r.file_id: r.bin for r in maintenance.bins(df, 10).collect()}
    assert got == {0: 0, 1: 0, 2: 0}  # 5 would pass the target, 5 + 6 too, and so on: bins of one are left out


def test_register_and_reset(spark, tmp_path):
    led = Ledger(spark, str(tmp_path / "ledger"))
    for i in range(2):
        spark.createDataFrame([(f"owner{j}", j) for j in range(3 + i)], "owner string, shelf int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    assert files.register_parquet(led, "db", "parcels", [str(tmp_path / "in")]) == 2
    got = led.files().orderBy("min_lsn").select("min_lsn", "read_lsn", "row_count", "topic").collect()
    assert [tuple(r) for r in got] == [(1, 3, 3, "__backfill__"), (4, 7, 4, "__backfill__")]
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(SchemaError):
        files.register_parquet(led, "db", "parcels", [str(tmp_path / "in"), str(tmp_path / "bad")])
    files.reset_table(led, "db", "parcels")
    assert led.files().count() == 0
    files.register_parquet(led, "db", "parcels", [str(tmp_path / "in/0")])
    assert led.files().first().min_lsn == 8


def test_gate(spark):
    gate = Gate(TableSchema(4, (Field(1, "owner", "string"), Field(2, "shelf", "int"))))
    entries = gate.admit([Field(1, "owner", "string"), Field(2, "shelf", "int"), Field(3, "hall", "string")])
    assert entries[0]["schema_after"] == 5 and gate.table.fields[-1] == Field(3, "hall", "string")
    assert gate.admit([Field(1, "owner", "string"), Field(2, "shelf", "int")], older=True) == []
    with pytest.raises(SchemaError, match="changed type"):
        gate.admit([Field(1, "owner", "string"), Field(2, "shelf", "string"), Field(3, "hall", "string")])
    assert gate.paused
    manual = Gate(TableSchema(1, ()), mode="manual")
    with pytest.raises(SchemaError, match="new fields"):
        manual.admit([Field(1, "a", "int")])
    failing = Gate(TableSchema(1, (Field(1, "a", "int"),)), on_breaking="fail")
    with pytest.raises(SchemaError, match="removed"):
        failing.admit([])
    assert not failing.paused


def test_sql_catalog(tmp_path):
    c = SqlCatalog(str(tmp_path / "c.db"))
    c.create_table("db", "t", "/w", "{}")
    assert c.namespaces() == ["db"] and c.tables("db") == ["t"] and c.load("db", "x") is None
    c.commit("db", "t", None, 1, [{"file_path": "a", "file_size_bytes": 1, "record_count": 2}])
    with pytest.raises(CommitConflict):
        c.commit("db", "t", None, 2, [])
    c.commit("db", "t", 1, 2, [{"file_path": "b", "file_size_bytes": 1, "record_count": 2}], removed=["a"])
    assert [f["file_path"] for f in c.files("db", "t")] == ["b"] and c.load("db", "t")["snapshot_id"] == 2
    assert c.update_schema("db", "t", 0, "{1}") == 1
    with pytest.raises(CommitConflict):
        c.update_schema("db", "t", 0, "{2}")
    c.reset("db", "t")
    assert c.files("db", "t") == []


def test_scans_and_leases(spark, tmp_path):
    led, now = Ledger(spark, str(tmp_path / "ledger")), [0.0]
    log.append(str(tmp_path / "log"), "t", 0, messages(6))
    Sink(led, str(tmp_path / "table"), table="t").write_batch(log.read_log(spark, str(tmp_path / "log"), "t"), 0)
    tables = Tables(led, most=1, lease_s=10, clock=lambda: now[0])
    assert tables.names() == [("default", "t")] and "read_lsn" in tables.schema("default", "t").names
    scan, rows = tables.begin("default", "t", 4)
    assert rows.count() == 4 and len(tables.pinned()) == 1 and len(to_ipc(rows)) > 0
    with pytest.raises(ReadStateError, match="open"):
        tables.begin("default", "t")
    now[0] = 11.0
    assert tables.pinned() == set()
    with pytest.raises(ReadStateError):
        tables.end(scan)
    with pytest.raises(ReadStateError, match="ahead"):
        tables.begin("default", "t", 100)


def test_state_machines():
    now = [0.0]
    b = CircuitBreaker(clock=lambda: now[0])
    for _ in range(5):
        b.failure()
    assert b.state == "open" and not b.allow()
    now[0] = 30.0
    assert b.state == "half_open"
    b.success(), b.success()
    assert b.state == "closed"
    cache = TtlCache(clock=lambda: now[0])
    assert [cache.get("snapshot", "t", lambda: 1), cache.get("snapshot", "t", lambda: 2)] == [1, 1] and cache.hit_rate() == 0.5
    now[0] += 1.5
    assert cache.get("snapshot", "t", lambda: 3) == 3
    h = Health()
    h.mark("a", "degraded")
    assert h.status() == "degraded" and h.ready()
    h.block("schema", "x")
    assert not h.ready()
    assert prometheus({"rows_total": 3}, "p_") == "# TYPE p_rows_total counter\np_rows_total 3\n"


def test_endpoint():
    import urllib.error
    import urllib.request

    h = Health()
    server = serve(h, lambda: {"rows_total": 1})
    url = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{url}/readyz"))["ready"]
    assert b"tidelake_rows_total 1" in urllib.request.urlopen(f"{url}/metrics").read()
    h.mark("source", "unhealthy")
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"{url}/health")
    assert e.value.code == 503
    server.shutdown()


def test_eviction(spark):
    limits = {"max_bytes": 100, "max_rows": 50, "batch_rows": 10, "ttl_s": 60, "interval_s": 30}
    states = [(100, 0, 0, 0), (0, 50, 0, 0), (0, 10, 0, 0), (0, 1, 60, 0), (0, 1, 0, 30), (0, 1, 0, 0)]
    got = [r.decision for r in eviction(spark.createDataFrame(states, "bytes long, rows long, age_s long, since_flush_s long").coalesce(1), limits).collect()]
    assert got == ["evict_immediate", "count", "count", "ttl", "interval", "none"]
