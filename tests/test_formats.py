"""Frames, Protobuf, types, configuration, registries and expressions."""

import datetime
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import config
from tidelake.errors import ConfigError, DecodeError, SchemaError
from tidelake.functions import exprs, types
from tidelake.operators import proto, schema
from tidelake.sources.log import kafka_options
from tidelake.sources.registry import HttpRegistry, InMemoryRegistry, sources_of

PARCEL = """syntax = "proto3"; package depot.v2;
import "google/protobuf/timestamp.proto";
message Parcel { // what a depot knows of a parcel
  enum Class { PLAIN = 0; FRAGILE = 1; }
  message Box { int32 sides = 1; double litres = 2; }
  uint64 code = 1; repeated double scales = 2; Box box = 3; map<string, int32> stops = 4; string owner = 5; double kilos = 6; int32 shelf = 7;
  oneof place { int32 lane = 8; string hall = 9; }
  google.protobuf.Duration waited = 11; google.protobuf.Timestamp seen = 12; optional int32 note = 13; Class kind = 14; sint32 drift = 15; repeated Class marks = 16;
}"""


def tag(n, wire):
    return proto.encode_varint(n << 3 | wire)


def sub(n, data):
    return tag(n, 2) + proto.encode_varint(len(data)) + data


BODY = (
    tag(1, 0) + proto.encode_varint(2**64 - 1) + sub(2, struct.pack("<ddd", 0.5, -4.0, 9.25)) + sub(3, tag(1, 0) + b"\x06" + tag(2, 1) + struct.pack("<d", 12.75)) + sub(4, sub(1, b"harbour") + tag(2, 0) + b"\x11")
    + sub(5, b"Ada") + tag(6, 1) + struct.pack("<d", 3.125) + tag(7, 0) + b"\x63" + sub(9, b"north") + sub(11, tag(1, 0) + b"\x05" + tag(2, 0) + proto.encode_varint(7000))
    + sub(12, tag(1, 0) + proto.encode_varint(1_600_000_000) + tag(2, 0) + proto.encode_varint(2500)) + tag(14, 0) + b"\x01" + tag(15, 0) + b"\x05" + sub(16, b"\x01\x00\x09")
)


def test_proto_decode(spark):
    rows = spark.createDataFrame([(bytearray(proto.frame(7, BODY)), 1), (bytearray(proto.frame(7, b"")), 2)], "value binary, n int")
    full, bare = proto.decode_framed(rows, {7: PARCEL}, "depot.v2.Parcel").orderBy("n").collect()
    assert int(full.code) == 2**64 - 1 and full.scales == [0.5, -4.0, 9.25] and tuple(full.box) == (6, 12.75) and full.stops == {"harbour": 17}
    assert (full.owner, full.kilos, full.shelf, full.note, full.kind, full.drift, full.marks) == ("Ada", 3.125, 99, None, "FRAGILE", -3, ["FRAGILE", "PLAIN", "9"])
    assert full.place_json == '{"field":"hall","field_number":9,"value":"north"}' and full.waited == 5_000_007
    assert full._schema_id == 7 and full._message_type == "depot.v2.Parcel" and full.seen == datetime.datetime.fromtimestamp(1_600_000_000.000002)
    assert (bare.owner, bare.shelf, bare.box, bare.scales, bare.stops, bare.place_json, bare.kind) == ("", 0, None, [], {}, None, "PLAIN")


@pytest.mark.parametrize("data", [b"", b"\0\0\0\0\1", b"\1\0\0\0\1\0", b"\0\0\0\0\1\xff", b"\0\0\0\0\1\1"])
def test_bad_frames(data):
    with pytest.raises(DecodeError):
        proto.parse_frame(data)


def test_nested_frame_path():
    assert proto.parse_frame(b"\0\0\0\0\x2a\x04\x02\x00rest") == (42, [1, 0], b"rest")


@given(st.integers(0, 2**32 - 1), st.binary(max_size=20))
@settings(max_examples=50, deadline=None)
def test_frame_round_trip(schema_id, payload):
    assert proto.parse_frame(proto.frame(schema_id, payload)) == (schema_id, [0], payload)


@given(st.integers(0, 2**64 - 1))
@settings(max_examples=50, deadline=None)
def test_varint_round_trip(n):
    data = proto.encode_varint(n)
    assert proto._varint(data, 0) == (n, len(data))


def test_reserved_and_missing_names():
    with pytest.raises(ConfigError, match="metadata"):
        proto.columns(proto.parse("message M { string topic = 1; }"))
    with pytest.raises(ConfigError):
        proto.parse("message A { B b = 1; }")
    assert proto.subject("topic_name", "t", None) == "t-value" and proto.subject("topic_record_name", "t", "a.M") == "t-a.M"


def test_types_round_trip():
    for name in ("boolean", "int", "long", "decimal(9, 2)", "timestamptz", "timestamp", "date", "binary"):
        assert types.text_of(types.parse(name)) == name
    kind = T.StructType([T.StructField("a", T.ArrayType(T.LongType())), T.StructField("m", T.MapType(T.StringType(), T.DoubleType()), False)])
    assert types.parse(types.text_of(kind)).simpleString() == kind.simpleString()
    assert schema.same_type({"type": "list", "element-id": 3, "element": "int"}, {"type": "list", "element-id": 9, "element": "int"})
    assert types.from_hive("array<bigint>") == "list<long>" and types.to_hive("timestamptz") == "timestamp"
    with pytest.raises(SchemaError):
        types.parse("colour")


def test_bucket_hash(spark):
    got = spark.createDataFrame([(34,), (-1,)], "x long").select(exprs.murmur3_long(F.col("x")).alias("h")).collect()
    assert got[0].h == 2017239379  # a known value of the hash


def test_expressions(spark):
    df = spark.createDataFrame([(bytearray(b"k"), None, "topic", bytearray(b"\xff"))], "k binary, v binary, t string, bad binary")
    r = df.select(exprs.message_size(F.col("k"), F.col("v"), F.col("t")).alias("n"), exprs.utf8_or_null(F.col("bad")).alias("u"), exprs.file_crc32(F.lit(b"123456789")).alias("c"), exprs.frame_schema_id(F.lit(b"\0\0\0\1\0\0")).alias("s"), exprs.looks_like(F.lit("2024-01-01")).alias("d")).first()
    assert (r.n, r.u, r.c, r.s, r.d) == (30, None, "cbf43926", 256, "date")


def test_config(tmp_path):
    (tmp_path / "secret").write_text("hunter2\n")
    text = f"""[kafka]\ntopic = "t"\n[kafka.security]\nsasl_mechanism = "PLAIN"\nsasl_username = "u"\nsasl_password = {{ file = "{tmp_path}/secret" }}\n[table]\nwarehouse_path = "s3://b/p"\ntable_name = "t" """
    c = config.load(text, {"TIDELAKE_KAFKA_BATCH_SIZE": "7"})
    assert config.problems(c) == [] and c.kafka.batch_size == 7 and "hunter2" not in repr(c) and c.kafka.security.sasl_password.reveal() == "hunter2"
    assert 'password="hunter2"' in kafka_options(c.kafka)["kafka.sasl.jaas.config"] and kafka_options(c.kafka)["maxOffsetsPerTrigger"] == "7"
    assert config.warehouse("abfs://c@acct/dir/x") == ("abfs", "c@acct", "dir/x")
    for bad in ("[kafka]\ncolour = 1", '[table]\ncompression = "brotli"'):
        with pytest.raises(ConfigError):
            config.load(bad, {})
    with pytest.raises(ConfigError):
        config.load("", {"TIDELAKE_KAFKA_BATCH_SIZE": "many"})
    assert "kafka.topic is empty" in config.problems(config.Config())


def test_registries(tmp_path):
    r = InMemoryRegistry()
    r.register("base", "message Base { int32 a = 1; }")
    top = r.register("top", "message Top { Base b = 1; }", references=[("base.proto", "base", 1)])
    assert len(sources_of(r, top)) == 2 and r.latest("top").version == 1
    up = [True]

    def fetch(path):
        if not up[0]:
            raise OSError("down")
        return {"schema": "message M {}", "id": 5, "version": 2}

    now = [0.0]
    h = HttpRegistry("http://x", str(tmp_path), fetch=fetch, clock=lambda: now[0])
    assert h.by_id(5).source == "message M {}"
    up[0], now[0] = False, 1000.0
    assert h.by_id(5).source == "message M {}"  # the last good copy
    with pytest.raises(SchemaError):
        h.by_id(6)


def test_json_inference(spark):
    docs = ['{"i":1,"big":5000000000,"f":1.5,"b":true,"s":"x","n":null,"mix":1}', '{"i":2,"big":1,"f":2,"b":false,"s":"2024-01-01","n":null,"mix":2.5,"u":"123e4567-e89b-12d3-a456-426614174000","t":"2024-01-01T00:00:00Z","o":{"a":1}}']
    got = {r.name: (r.type, r.required) for r in schema.infer(spark.createDataFrame([(d,) for d in docs], "value string")).collect()}
    assert got == {"i": ("int", True), "big": ("long", True), "f": ("double", True), "b": ("boolean", True), "s": ("string", True), "n": ("string", False), "mix": ("double", True), "u": ("uuid", False), "t": ("timestamptz", False), "o": ("string", False)}
