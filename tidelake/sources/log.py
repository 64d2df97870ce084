"""Message logs as Spark sources: Kafka where its jar is there, and a log of files that is always there.

The file log keeps a topic as ``<folder>/<topic>/<partition>/<first offset>.jsonl``: JSON lines with
base64 key and value.  It reads as a batch or a stream through Spark's Python data sources, with the
row shape of ``model.MESSAGE``; offsets of a stream are the next offset of each partition.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidelake.config import Kafka
from tidelake.model import MESSAGE

FORMAT = "tidelake_log"


def append(folder: str, topic: str, partition: int, messages: list[dict]) -> int:
    """Adds messages (``key``, ``value`` as bytes or None, ``timestamp``, ``headers``) to a partition;
    returns the offset after them."""
    path = os.path.join(folder, topic, str(partition))
    os.makedirs(path, exist_ok=True)
    at = _end(path)
    enc = lambda b: None if b is None else base64.b64encode(b).decode()
    lines = [json.dumps({"offset": at + i, "key": enc(m.get("key")), "value": enc(m.get("value")), "timestamp": m.get("timestamp", 0), "headers": [[k, enc(v if v is not None else b"")] for k, v in m.get("headers", [])]}) for i, m in enumerate(messages)]
    tmp = os.path.join(path, f".{at}")
    with open(tmp, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.rename(tmp, os.path.join(path, f"{at:020d}.jsonl"))
    return at + len(messages)


def _segments(path: str) -> list[str]:
    return sorted(n for n in os.listdir(path) if n.endswith(".jsonl"))


def _end(path: str) -> int:
    names = _segments(path)
    if not names:
        return 0
    with open(os.path.join(path, names[-1])) as f:
        return int(names[-1].split(".")[0]) + sum(1 for _ in f)


def _partitions(folder: str, topic: str) -> dict[str, int]:
    root = os.path.join(folder, topic)
    return {p: _end(os.path.join(root, p)) for p in sorted(os.listdir(root), key=int)} if os.path.isdir(root) else {}


class _Range(InputPartition):
    def __init__(self, partition: str, first: int, end: int):
        self.partition, self.first, self.end = partition, first, end


def _read(folder: str, topic: str, r: _Range) -> Iterator[tuple]:
    path = os.path.join(folder, topic, r.partition)
    names = _segments(path)
    dec = lambda s: None if s is None else base64.b64decode(s)
    for n, after in zip(names, [*names[1:], None], strict=True):
        if int(n.split(".")[0]) >= r.end or after is not None and int(after.split(".")[0]) <= r.first:
            continue
        with open(os.path.join(path, n)) as f:
            for line in f:
                m = json.loads(line)
                if r.first <= m["offset"] < r.end:
                    yield dec(m["key"]), dec(m["value"]), topic, int(r.partition), m["offset"], m["timestamp"], [(k, dec(v)) for k, v in m["headers"]]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.topic = options["path"], options["topic"]

    def partitions(self):
        return [_Range(p, 0, end) for p, end in _partitions(self.folder, self.topic).items()]

    def read(self, r):
        return _read(self.folder, self.topic, r)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.topic = options["path"], options["topic"]
        self.most, self.at = int(options.get("maxoffsetspertrigger", 0)), None
        self.start = options.get("startingoffsets", "earliest")

    def initialOffset(self):
        ends = _partitions(self.folder, self.topic)
        return json.loads(self.start) if self.start.startswith("{") else ends if self.start == "latest" else dict.fromkeys(ends, 0)

    def latestOffset(self):
        ends = _partitions(self.folder, self.topic)
        if not self.most:
            return ends
        self.at = self.at if self.at is not None else self.initialOffset()
        share = max(1, self.most // max(1, len(ends)))
        self.at = {p: min(end, self.at.get(p, 0) + share) for p, end in ends.items()}
        return self.at

    def partitions(self, start, end):
        return [_Range(p, start.get(p, 0), e) for p, e in end.items() if e > start.get(p, 0)]

    def read(self, r):
        return _read(self.folder, self.topic, r)

    def commit(self, end):
        self.at = end


class LogSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return MESSAGE

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def read_log(spark: SparkSession, folder: str, topic: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("path", folder).option("topic", topic).load()


def stream_log(spark: SparkSession, folder: str, topic: str, starting: str = "earliest", most: int = 0) -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).option("path", folder).option("topic", topic).option("startingOffsets", starting).option("maxOffsetsPerTrigger", str(most)).load()


def kafka_options(k: Kafka) -> dict[str, str]:
    """Options of Spark's Kafka source for a configuration."""
    out = {
        "kafka.bootstrap.servers": ",".join(k.bootstrap_servers), "subscribe": k.topic, "startingOffsets": k.auto_offset_reset, "maxOffsetsPerTrigger": str(k.batch_size), "includeHeaders": "true", "failOnDataLoss": "true",
        "kafka.session.timeout.ms": str(k.session_timeout_ms), "kafka.heartbeat.interval.ms": str(k.heartbeat_interval_ms), "kafka.max.poll.interval.ms": str(k.max_poll_interval_ms), "kafka.group.id": k.consumer_group,
    }
    s = k.security
    if s.protocol:
        out["kafka.security.protocol"] = s.protocol
    if s.sasl_mechanism:
        module = "scram.ScramLoginModule" if s.sasl_mechanism.startswith("SCRAM") else "plain.PlainLoginModule"
        out |= {"kafka.sasl.mechanism": s.sasl_mechanism, "kafka.sasl.jaas.config": f'org.apache.kafka.common.security.{module} required username="{s.sasl_username.reveal()}" password="{s.sasl_password.reveal()}";'}
    for name, value in (("ssl.truststore.location", s.ssl_ca_location), ("ssl.keystore.certificate.chain", s.ssl_cert_location), ("ssl.keystore.key", s.ssl_key_location)):
        if value:
            out[f"kafka.{name}"] = value
    return out


def stream_kafka(spark: SparkSession, k: Kafka) -> DataFrame:
    """The Kafka topic in the shape of ``model.MESSAGE``; needs the connector's jar."""
    from pyspark.sql import functions as F

    from tidelake.functions.exprs import headers_without_nulls

    raw = spark.readStream.format("kafka").options(**kafka_options(k)).load()
    return raw.select("key", "value", "topic", "partition", "offset", F.unix_millis("timestamp").alias("timestamp"), headers_without_nulls(F.col("headers")).alias("headers"))
