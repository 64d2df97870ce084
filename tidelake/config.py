"""Configuration: a TOML file, secrets from files, overrides from ``TIDELAKE_*`` variables, and checks."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import get_type_hints
from urllib.parse import urlparse

from tidelake.errors import ConfigError

PREFIX = "TIDELAKE_"


class Secret:
    """A text that isn't shown."""

    def __init__(self, value: str):
        self._value = value

    def reveal(self) -> str:
        return self._value

    def __repr__(self) -> str:
        return "Secret(***)"

    __str__ = __repr__


@dataclass
class Security:
    protocol: str | None = None
    sasl_mechanism: str | None = None
    sasl_username: Secret | None = None
    sasl_password: Secret | None = None
    ssl_ca_location: str | None = None
    ssl_cert_location: str | None = None
    ssl_key_location: str | None = None


@dataclass
class Format:
    type: str = "raw"
    schema_registry_url: str | None = None
    subject_strategy: str = "topic_name"
    message_type: str | None = None
    cache_ttl_seconds: int = 300
    latest_on_startup: bool = True


@dataclass
class Kafka:
    bootstrap_servers: list = field(default_factory=lambda: ["localhost:9092"])
    topic: str = ""
    consumer_group: str = "tidelake"
    batch_size: int = 1000
    batch_timeout_ms: int = 5000
    session_timeout_ms: int = 30_000
    heartbeat_interval_ms: int = 3000
    max_poll_interval_ms: int = 300_000
    auto_offset_reset: str = "earliest"
    security: Security = field(default_factory=Security)
    format: Format = field(default_factory=Format)


@dataclass
class Evolution:
    mode: str = "auto"
    on_breaking_change: str = "pause"
    min_interval_seconds: int = 0


@dataclass
class Table:
    catalog_type: str = "ledger"
    warehouse_path: str = ""
    database_name: str = "default"
    table_name: str = ""
    target_file_size_mb: int = 512
    compression: str = "snappy"
    partition_strategy: str = "daily"
    rest_uri: str | None = None
    hive_metastore_uri: str | None = None
    aws_region: str | None = None
    aws_access_key_id: Secret | None = None
    aws_secret_access_key: Secret | None = None
    credential: Secret | None = None


@dataclass
class Buffer:
    ttl_seconds: int = 60
    max_size_mb: int = 500
    flush_interval_seconds: int = 30
    flush_batch_size: int = 10_000
    memory_alignment_bytes: int = 64


@dataclass
class LedgerSettings:
    log_dir: str = "./ledger"
    checkpoint_interval_entries: int = 10_000
    checkpoint_interval_seconds: int = 300
    keep_versions: int = 10


@dataclass
class Maintenance:
    compaction_enabled: bool = True
    compaction_interval_seconds: int = 3600
    compaction_threshold_mb: int = 100
    compaction_target_mb: int = 512
    snapshot_retention_days: int = 7
    orphan_retention_days: int = 3


@dataclass
class Monitoring:
    health_port: int = 8080
    metrics_prefix: str = "tidelake_"


@dataclass
class Config:
    kafka: Kafka = field(default_factory=Kafka)
    schema_evolution: Evolution = field(default_factory=Evolution)
    table: Table = field(default_factory=Table)
    buffer: Buffer = field(default_factory=Buffer)
    ledger: LedgerSettings = field(default_factory=LedgerSettings)
    maintenance: Maintenance = field(default_factory=Maintenance)
    monitoring: Monitoring = field(default_factory=Monitoring)


#: What the choices may be.
CHOICES = {
    "kafka.auto_offset_reset": ("earliest", "latest"), "kafka.format.type": ("raw", "json", "protobuf"), "kafka.format.subject_strategy": ("topic_name", "record_name", "topic_record_name"),
    "schema_evolution.mode": ("auto", "manual"), "schema_evolution.on_breaking_change": ("pause", "fail", "skip_message"), "table.compression": ("snappy", "gzip", "lz4", "zstd", "none"),
    "table.catalog_type": ("ledger", "sql", "rest", "hive", "glue", "nessie"), "table.partition_strategy": ("daily", "hourly", "identity", "bucket"),
}


def _value(kind, given, where: str):
    if isinstance(given, dict) and set(given) == {"file"}:
        given = Path(given["file"]).read_text().strip()
    text = str(kind)
    if "Secret" in text:
        return Secret(str(given))
    if kind is bool and isinstance(given, str):
        if given.lower() not in ("true", "false"):
            raise ConfigError(f"{where}: {given!r} isn't true or false")
        return given.lower() == "true"
    if kind is int:
        try:
            return int(given)
        except (TypeError, ValueError) as e:
            raise ConfigError(f"{where}: {given!r} isn't a number") from e
    if kind is list:
        return given.split(",") if isinstance(given, str) else list(given)
    return given


def _fill(cls, given: dict, where: str, env: dict[str, str]):
    kinds, out = get_type_hints(cls), {}
    if unknown := set(given) - {f.name for f in fields(cls)}:
        raise ConfigError(f"{where or 'the file'}: unknown {sorted(unknown)}")
    for f in fields(cls):
        name = f"{where}.{f.name}" if where else f.name
        if is_dataclass(kinds[f.name]):
            out[f.name] = _fill(kinds[f.name], given.get(f.name, {}), name, env)
        elif (key := PREFIX + name.replace(".", "_").upper()) in env:
            out[f.name] = _value(kinds[f.name], env[key], name)
        elif f.name in given:
            out[f.name] = _value(kinds[f.name], given[f.name], name)
        if name in CHOICES and out.get(f.name, CHOICES[name][0]) not in CHOICES[name]:
            raise ConfigError(f"{name}: {out[f.name]!r} isn't one of {CHOICES[name]}")
    return cls(**out)


def load(text: str = "", env: dict[str, str] | None = None) -> Config:
    return _fill(Config, tomllib.loads(text), "", dict(os.environ if env is None else env))


def load_file(path: str) -> Config:
    try:
        return load(Path(path).read_text())
    except OSError as e:
        raise ConfigError(f"{path}: {e}") from e


def problems(c: Config) -> list[str]:
    """What keeps a configuration from being used."""
    out = []
    need = lambda ok, what: None if ok else out.append(what)
    need(c.kafka.topic, "kafka.topic is empty")
    need(c.kafka.bootstrap_servers, "kafka.bootstrap_servers is empty")
    need(c.kafka.batch_size > 0, "kafka.batch_size must be above 0")
    need(c.kafka.session_timeout_ms > c.kafka.heartbeat_interval_ms, "kafka.session_timeout_ms must be above the heartbeat")
    need(c.kafka.max_poll_interval_ms > 1000 * c.buffer.flush_interval_seconds, "kafka.max_poll_interval_ms must be above the flush interval")
    need(c.table.warehouse_path, "table.warehouse_path is empty")
    need(c.table.table_name, "table.table_name is empty")
    need(c.buffer.max_size_mb > 0 and c.buffer.flush_batch_size > 0, "buffer sizes must be above 0")
    need(c.buffer.memory_alignment_bytes & (c.buffer.memory_alignment_bytes - 1) == 0, "buffer.memory_alignment_bytes must be a power of two")
    need(c.maintenance.compaction_threshold_mb < c.maintenance.compaction_target_mb, "maintenance.compaction_threshold_mb must be below the target")
    need(c.kafka.format.type != "protobuf" or c.kafka.format.schema_registry_url, "protobuf needs kafka.format.schema_registry_url")
    need(c.kafka.format.subject_strategy == "topic_name" or c.kafka.format.message_type, "this subject strategy needs kafka.format.message_type")
    need(not c.kafka.security.sasl_mechanism or (c.kafka.security.sasl_username and c.kafka.security.sasl_password), "SASL needs a user and a password")
    need(c.table.catalog_type != "rest" or c.table.rest_uri, "the rest catalog needs table.rest_uri")
    need(c.table.catalog_type != "hive" or c.table.hive_metastore_uri, "the hive catalog needs table.hive_metastore_uri")
    return out


def catalog_options(c: Table, name: str = "lake") -> dict[str, str]:
    """Spark settings of an outside catalog; its runtime's jar has to be on the classpath."""
    key, out = f"spark.sql.catalog.{name}", {}
    if c.catalog_type in ("ledger", "sql"):
        return out
    out[key] = "org.apache.iceberg.spark.SparkCatalog"
    out[f"{key}.warehouse"] = c.warehouse_path
    if c.catalog_type == "rest":
        out |= {f"{key}.type": "rest", f"{key}.uri": c.rest_uri or ""}
        if c.credential:
            out[f"{key}.credential" if ":" in c.credential.reveal() else f"{key}.token"] = c.credential.reveal()
    elif c.catalog_type == "hive":
        out |= {f"{key}.type": "hive", f"{key}.uri": c.hive_metastore_uri or ""}
    else:
        out[f"{key}.catalog-impl"] = {"glue": "org.apache.iceberg.aws.glue.GlueCatalog", "nessie": "org.apache.iceberg.nessie.NessieCatalog"}[c.catalog_type]
    return out


def warehouse(uri: str) -> tuple[str, str, str]:
    """A warehouse's scheme, bucket (or container@account) and prefix."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return "file", "", u.path
    if u.scheme not in ("s3", "s3a", "gs", "abfs", "abfss", "hdfs", "viewfs"):
        raise ConfigError(f"no store for {u.scheme}")
    return u.scheme, u.netloc, u.path.strip("/")


def filesystem_options(c: Table) -> dict[str, str]:
    """Hadoop settings of the warehouse's store."""
    scheme, _, _ = warehouse(c.warehouse_path)
    if scheme not in ("s3", "s3a"):
        return {}
    out = {"spark.hadoop.fs.s3.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem"}
    if c.aws_region:
        out["spark.hadoop.fs.s3a.endpoint.region"] = c.aws_region
    if c.aws_access_key_id and c.aws_secret_access_key:
        out |= {"spark.hadoop.fs.s3a.access.key": c.aws_access_key_id.reveal(), "spark.hadoop.fs.s3a.secret.key": c.aws_secret_access_key.reveal()}
    return out
