"""Reading a table while it is written: scans with leases, Arrow output, and an HTTP endpoint."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.errors import ReadStateError
from tidelake.operators.health import Health, prometheus
from tidelake.operators.ledger import Coordinator, Ledger
from tidelake.operators.lookups import check_not_ahead
from tidelake.operators.snapshot import Snapshot


class Tables:
    """Scans of the ledger's tables.  A scan pins its files in the ledger until it ends or its lease
    runs out, so that maintenance anywhere leaves them alone."""

    def __init__(self, ledger: Ledger, log: DataFrame | None = None, most: int = 64, lease_s: float = 300, clock: Callable[[], float] = time.monotonic):
        self.ledger, self.log, self.most, self.lease_s, self.clock = ledger, log, most, lease_s, clock
        self._scans: dict[str, tuple[float, frozenset[str]]] = {}
        self._lock = threading.Lock()

    def names(self) -> list[tuple[str, str]]:
        rows = self.ledger.files().select("database", "table").distinct().orderBy("database", "table").collect()  # a row a table
        return [(r.database, r.table) for r in rows]

    def _files(self, database: str, table: str) -> DataFrame:
        return self.ledger.files().filter((F.col("database") == database) & (F.col("table") == table))

    def schema(self, database: str, table: str) -> pa.Schema:
        """The table's columns in Arrow."""
        return Snapshot(self.ledger.spark, self._files(database, table), self.log).read().limit(0).toArrow().schema

    def current_lsn(self, database: str, table: str) -> int:
        cold = self._files(database, table).agg(F.max("read_lsn")).first()[0] or 0
        hot = self.log.agg(F.max("read_lsn")).first()[0] or 0 if self.log is not None and "read_lsn" in self.log.columns else 0
        return max(cold, hot)

    def wait_for(self, database: str, table: str, lsn: int, timeout_s: float = 0.0, every_s: float = 0.05) -> None:
        """Until the table has a sequence number; raises once the time is over."""
        end = self.clock() + timeout_s
        while (now := self.current_lsn(database, table)) < lsn:
            if self.clock() >= end:
                check_not_ahead(now, lsn)
            time.sleep(every_s)

    def begin(self, database: str, table: str, lsn: int | None = None, timeout_s: float = 0.0) -> tuple[str, DataFrame]:
        """A scan's id and its rows."""
        if lsn is not None:
            self.wait_for(database, table, lsn, timeout_s)
        snapshot = Snapshot(self.ledger.spark, self._files(database, table), self.log, lsn)
        rows, scan = snapshot.read(), uuid.uuid4().hex
        with self._lock:
            self._expire()
            if len(self._scans) >= self.most:
                raise ReadStateError(f"{self.most} scans are open")
            paths = sorted(snapshot.paths())
            self._scans[scan] = (self.clock() + self.lease_s, frozenset(paths))
        until = int((time.time() + self.lease_s) * 1000)
        Coordinator(self.ledger).commit(lambda v: [{"type": "FilesPinned", "database": database, "table": table, "batch_id": scan, "file_paths": paths, "until": until}])
        return scan, rows

    def end(self, scan: str) -> None:
        with self._lock:
            if self._scans.pop(scan, None) is None:
                raise ReadStateError(f"no scan {scan}")
        Coordinator(self.ledger).commit(lambda v: [{"type": "FilesReleased", "batch_id": scan}])

    def _expire(self) -> None:
        self._scans = {k: v for k, v in self._scans.items() if v[0] > self.clock()}

    def pinned(self) -> set[str]:
        """Files that maintenance has to leave alone."""
        with self._lock:
            self._expire()
            return {p for _, paths in self._scans.values() for p in paths}


def to_ipc(rows: DataFrame) -> bytes:
    """Rows as an Arrow stream; for results that fit the driver."""
    table, out = rows.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def serve(health: Health, metrics: Callable[[], dict], port: int = 0, prefix: str = "tidelake_") -> ThreadingHTTPServer:
    """``/health``, ``/healthz``, ``/readyz`` and ``/metrics``, in a thread of their own."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path in ("/health", "/healthz"):
                status, body = 200 if health.status() != "unhealthy" else 503, json.dumps({"status": health.status(), "components": {k: v[0] for k, v in health.components.items()}})
            elif self.path == "/readyz":
                status, body = (200 if health.ready() else 503), json.dumps({"ready": health.ready(), "blockers": health.blockers})
            elif self.path == "/metrics":
                status, body = 200, prometheus(metrics(), prefix)
            else:
                status, body = 404, "{}"
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if self.path == "/metrics" else "application/json")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
