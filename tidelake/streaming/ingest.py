"""The sink that a configuration asks for: its decoder, its schema gate and its policy at the start."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.config import Config
from tidelake.errors import DecodeError, SchemaError
from tidelake.functions import types
from tidelake.functions.exprs import frame_schema_id, utf8_or_null
from tidelake.model import METADATA
from tidelake.operators import proto, schema
from tidelake.operators.ledger import Ledger
from tidelake.operators.schema import Field, TableSchema
from tidelake.sources.registry import HttpRegistry, sources_of
from tidelake.streaming.sink import Gate, Sink


def table_schema(ledger: Ledger, database: str, table: str) -> TableSchema:
    """A table's own fields as its schema changes made them; without any, version 0 with none."""
    rows = ledger.entries().filter((F.col("type") == "SchemaChanged") & (F.col("database") == database) & (F.col("table") == table))
    out = TableSchema(0, ())
    for r in rows.orderBy("seq").select("schema_after", "fields_added").collect():  # a row a change
        top = len(out.fields)
        out = TableSchema(r.schema_after, out.fields + tuple(Field(top + i, f.name, f.type, False, f.doc) for i, f in enumerate(r.fields_added, 1)))
    return out


def own_fields(rows: DataFrame) -> list[Field]:
    """The columns that came out of messages' values."""
    return [Field(i, f.name, str(types.text_of(f.dataType))) for i, f in enumerate((f for f in rows.schema if f.name not in METADATA), 1)]


class JsonDecoder:
    """JSON objects as typed columns: those of the table, then new ones with the types that the batch
    shows.  A value that its column can't hold is null only where it isn't of the batch's type either;
    a batch whose type doesn't fit the column reaches the gate as a change of type.  Values that aren't
    JSON objects fail the batch."""

    def __init__(self, gate: Gate):
        self.gate = gate

    def __call__(self, batch: DataFrame) -> DataFrame:
        texts = batch.drop("headers").withColumn("value", utf8_or_null(F.col("value")))
        found = schema.infer(texts.filter("value is not null")).select("name", "type", "seen", "nulls").limit(schema.MOST_NEW + len(self.gate.table.fields) + 1).collect()
        kinds = {f.name: f.type for f in self.gate.table.fields}
        if len(set(kinds) | {r.name for r in found}) > schema.MOST_NEW + len(kinds):
            raise SchemaError(f"more than {schema.MOST_NEW} new fields at once")
        for r in sorted(found, key=lambda r: r.name):
            if r.name in METADATA:
                raise SchemaError(f"a field has the name of a metadata column: {r.name}")
            if r.seen > r.nulls and not (r.name in kinds and schema.fits(r.type, kinds[r.name])):
                kinds[r.name] = r.type
        shape = T.StructType([T.StructField(n, types.parse(k)) for n, k in kinds.items()])
        rest = [c for c in texts.columns if c != "value"]
        made = F.from_json("value", shape, {"mode": "FAILFAST"}) if kinds else F.struct()
        return texts.select(*(made[n].alias(n) for n in kinds), *rest)


class ProtobufDecoder:
    """Framed Protobuf as the newest version's columns; versions come from the registry by the ids that
    a batch's frames carry, with what they import."""

    def __init__(self, registry, message: str | None):
        self.registry, self.message, self.known = registry, message, {}

    def learn(self, registered) -> None:
        self.known[registered.id] = sources_of(self.registry, registered)

    def __call__(self, batch: DataFrame) -> DataFrame:
        rows = batch.drop("headers").filter(F.col("value").isNotNull())
        for r in rows.select(frame_schema_id(F.col("value")).alias("id")).distinct().collect():  # an id a version
            if r.id is None:
                raise DecodeError("a value isn't a framed message")
            if r.id not in self.known:
                self.learn(self.registry.by_id(r.id))
        if not self.known:
            raise SchemaError("no version of the schema is known yet")
        return proto.decode_framed(rows, dict(self.known), self.message)


def at_start(gate: Gate, fields: list[Field]) -> list[dict]:
    """What the newest version in the registry means for the table before a message is read.  A new
    table takes all its fields, whatever the mode is; else the gate decides."""
    if not gate.table.fields:
        mode, gate.mode = gate.mode, "auto"
        try:
            return gate.admit(fields)
        finally:
            gate.mode = mode
    return gate.admit(fields)


def build(ledger: Ledger, c: Config, registry=None) -> Sink:
    """The sink for a configuration.  registry: in place of the one that the configuration names."""
    t, e = c.table, c.schema_evolution
    sink = Sink(
        ledger, t.warehouse_path, t.database_name, t.table_name, hourly=t.partition_strategy == "hourly", compression=t.compression,
        checkpoint_entries=c.ledger.checkpoint_interval_entries, checkpoint_s=c.ledger.checkpoint_interval_seconds,
    )
    kind = c.kafka.format.type
    if kind == "raw":
        return sink
    sink.gate = Gate(table_schema(ledger, t.database_name, t.table_name), e.mode, e.on_breaking_change, e.min_interval_seconds)
    sink.fields_of = own_fields
    if kind == "json":
        sink.decode = JsonDecoder(sink.gate)
        return sink
    f = c.kafka.format
    registry = registry or HttpRegistry(f.schema_registry_url, f"{c.ledger.log_dir}/registry" if "://" not in c.ledger.log_dir else None, f.cache_ttl_seconds)
    sink.decode = ProtobufDecoder(registry, f.message_type)
    sink.older = True  # messages of older versions go on arriving
    if f.latest_on_startup:
        newest = registry.latest(proto.subject(f.subject_strategy, c.kafka.topic, f.message_type))
        sink.decode.learn(newest)
        shape = proto.columns(proto.parse(*sources_of(registry, newest)), f.message_type)
        changes = at_start(sink.gate, [Field(i, x.name, str(types.text_of(x.dataType))) for i, x in enumerate(shape, 1)])
        if changes:
            ledger.append([{"database": t.database_name, "table": t.table_name} | x for x in changes])
    return sink


def maintain(ledger: Ledger, c: Config, now_ms: int | None = None) -> dict:
    """One round of the maintenance that the configuration turns on: small files, old snapshots, orphans."""
    from tidelake.operators import maintenance

    now, day = int(time.time() * 1000) if now_ms is None else now_ms, 86_400_000
    t, m, out = c.table, c.maintenance, {}
    if m.compaction_enabled:
        out["merged"] = maintenance.compact(ledger, t.database_name, t.table_name, t.warehouse_path, m.compaction_threshold_mb << 20, m.compaction_target_mb << 20)
    out["expired"] = maintenance.expire(ledger, t.database_name, t.table_name, now, m.snapshot_retention_days * day)
    out["orphans"] = maintenance.clean_orphans(ledger, f"{t.warehouse_path}/data", now, m.orphan_retention_days * day)
    return out
