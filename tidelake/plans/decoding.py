"""Events as framed Protobuf messages of two schema versions, and decoded again."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelake.operators import proto

_COMMON = "int64 user_id = 1; string event_type = 2; double amount = 3; oneof status { string status_text = 7; int32 status_code = 8; }"
SCHEMAS = {101: f'syntax = "proto3"; package demo.v1; message Event {{ {_COMMON} }}', 102: f'syntax = "proto3"; package demo.v1; message Event {{ {_COMMON} optional string team = 9; }}'}


def _text(number: int, s: str) -> bytes:
    data = s.encode()
    return proto.encode_varint(number << 3 | 2) + proto.encode_varint(len(data)) + data


def framed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_lsn``, ``value``: events with odd ids in the newer version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lsn, values = [], []
            for i, user, kind, amount in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                body = b"\x08" + proto.encode_varint(user) + _text(2, kind) + b"\x19" + struct.pack("<d", amount)
                if i % 3 == 0:
                    body += _text(7, "ok")
                elif i % 3 == 1:
                    body += b"\x40" + proto.encode_varint(i % 1000)
                if i % 2:
                    body += _text(9, "blue")
                lsn.append(i + 1)
                values.append(proto.frame(101 + i % 2, body))
            yield pa.RecordBatch.from_arrays([pa.array(lsn, pa.int64()), pa.array(values, pa.binary())], names=["read_lsn", "value"])

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    return events.mapInArrow(run, "read_lsn long, value binary")


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proto.decode_framed(framed_events(spark, sf_dir), SCHEMAS)
