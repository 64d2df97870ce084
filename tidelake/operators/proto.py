"""Protobuf without a compiler: proto3 source to fields, wire format to rows, rows to columns.

``decode_framed`` turns framed messages of several schema versions into one table with the columns of
the highest version; it runs over Arrow batches, and everything before and after it stays on the JVM.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidelake.errors import ConfigError, DecodeError
from tidelake.model import METADATA
from tidelake.operators.schema import Field

#: Spark's type for each scalar type of the language.
SCALARS = {
    "double": T.DoubleType(), "float": T.FloatType(), "int32": T.IntegerType(), "sint32": T.IntegerType(), "sfixed32": T.IntegerType(), "int64": T.LongType(), "sint64": T.LongType(),
    "sfixed64": T.LongType(), "uint32": T.LongType(), "fixed32": T.LongType(), "uint64": T.DecimalType(20, 0), "fixed64": T.DecimalType(20, 0), "bool": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(),
}
#: Names of the table's types.
TYPE_NAMES = {
    "double": "double", "float": "float", "int32": "int", "sint32": "int", "sfixed32": "int", "int64": "long", "sint64": "long", "sfixed64": "long", "uint32": "long", "fixed32": "long",
    "uint64": "decimal(20, 0)", "fixed64": "decimal(20, 0)", "bool": "boolean", "string": "string", "bytes": "binary",
}
_FIXED = {"double": "<d", "float": "<f", "fixed32": "<I", "sfixed32": "<i", "fixed64": "<Q", "sfixed64": "<q"}
TIMESTAMP, DURATION = "google.protobuf.Timestamp", "google.protobuf.Duration"


@dataclass
class ProtoField:
    name: str
    number: int
    type: str
    repeated: bool = False
    optional: bool = False
    oneof: str | None = None
    map_key: str | None = None  # then ``type`` is the value's


@dataclass
class Message:
    name: str
    fields: list[ProtoField] = field(default_factory=list)

    def by_number(self) -> dict[int, ProtoField]:
        return {f.number: f for f in self.fields}


@dataclass
class Pool:
    """Messages and enums by full name."""

    messages: dict[str, Message] = field(default_factory=dict)
    enums: dict[str, dict[int, str]] = field(default_factory=dict)

    def message(self, name: str | None) -> Message:
        """The message of that name, or the only one."""
        if name is None:
            if len(self.messages) != 1:
                raise ConfigError(f"which message? there are {sorted(self.messages)}")
            return next(iter(self.messages.values()))
        if name not in self.messages:
            raise ConfigError(f"no message {name}")
        return self.messages[name]


_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|[A-Za-z_.][\w.]*|-?\d[\w.]*|[{}()<>\[\]=;,]', re.S)


def parse(*sources: str) -> Pool:
    """The pool of proto3 sources, given with all they import."""
    pool, waiting = Pool(), []
    for source in sources:
        tokens = [t for t in _TOKEN.findall(source) if not t.startswith(("//", "/*"))]
        _Parser(tokens, pool, waiting).file()
    for f, scope in waiting:  # names are known now
        if f.type not in SCALARS and f.type not in (TIMESTAMP, DURATION):
            f.type = _resolve(f.type, scope, pool)
    return pool


def _resolve(name: str, scope: list[str], pool: Pool) -> str:
    if name.startswith("."):
        return name[1:]
    for i in range(len(scope), -1, -1):
        full = ".".join([*scope[:i], name])
        if full in pool.messages or full in pool.enums:
            return full
    raise ConfigError(f"no type {name}")


class _Parser:
    def __init__(self, tokens: list[str], pool: Pool, waiting: list):
        self.tokens, self.at, self.pool, self.waiting, self.package = tokens, 0, pool, waiting, []

    def next(self) -> str:
        self.at += 1
        if self.at > len(self.tokens):
            raise ConfigError("the source ends too soon")
        return self.tokens[self.at - 1]

    def want(self, token: str) -> None:
        if (got := self.next()) != token:
            raise ConfigError(f"{token} expected, not {got}")

    def skip(self) -> None:
        """To the end of a statement or of its block."""
        depth = 0
        while (t := self.next()) != ";" or depth:
            depth += (t == "{") - (t == "}")
            if t == "}" and not depth:
                return

    def file(self) -> None:
        while self.at < len(self.tokens):
            t = self.next()
            if t == "package":
                self.package = self.next().split(".")
                self.want(";")
            elif t == "message":
                self.message(self.package)
            elif t == "enum":
                self.enum(self.package)
            elif t != ";":
                self.skip()

    def enum(self, scope: list[str]) -> None:
        name, values = ".".join([*scope, self.next()]), {}
        self.want("{")
        while (t := self.next()) != "}":
            if t in ("option", "reserved"):
                self.skip()
                continue
            self.want("=")
            values.setdefault(int(self.next(), 0), t)
            self.skip()
        self.pool.enums[name] = values

    def message(self, scope: list[str]) -> None:
        scope = [*scope, self.next()]
        made = self.pool.messages.setdefault(".".join(scope), Message(".".join(scope)))
        self.want("{")
        while (t := self.next()) != "}":
            if t == "message":
                self.message(scope)
            elif t == "enum":
                self.enum(scope)
            elif t in ("option", "reserved", "extensions"):
                self.skip()
            elif t == "oneof":
                oneof = self.next()
                self.want("{")
                while (t := self.next()) != "}":
                    self.skip() if t == "option" else self.field(t, scope, made, oneof=oneof)
            elif t in ("repeated", "optional", "required"):
                self.field(self.next(), scope, made, repeated=t == "repeated", optional=t == "optional")
            elif t != ";":
                self.field(t, scope, made)

    def field(self, kind: str, scope: list[str], made: Message, **more) -> None:
        if kind == "map":
            self.want("<")
            more["map_key"] = self.next()
            self.want(",")
            kind = self.next()
            self.want(">")
        name = self.next()
        self.want("=")
        f = ProtoField(name, int(self.next(), 0), kind, **more)
        self.skip()
        made.fields.append(f)
        self.waiting.append((f, scope))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise DecodeError("a number is cut off" if at >= len(data) else "a number is too long")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & (1 << 64) - 1, at
        shift += 7


def parse_frame(value: bytes) -> tuple[int, list[int], bytes]:
    """A framed message's schema id, path of message indexes and payload."""
    if value is None or len(value) < 6:
        raise DecodeError("a frame has at least 6 bytes")
    if value[0] != 0:
        raise DecodeError(f"a frame begins with 0, not {value[0]}")
    zigzag = lambda n: (n >> 1) ^ -(n & 1)
    n, at = _varint(value, 5)
    n = zigzag(n)
    if n < 0:
        raise DecodeError("a path has no negative length")
    path = [0] if n == 0 else []
    for _ in range(n):
        i, at = _varint(value, at)
        if zigzag(i) < 0:
            raise DecodeError("a message index isn't negative")
        path.append(zigzag(i))
    return int.from_bytes(value[1:5], "big"), path, value[at:]


def _scalar(kind: str, raw: int | bytes):
    if kind in _FIXED:
        return struct.unpack(_FIXED[kind], raw)[0]
    if kind in ("int32", "int64"):
        bits = 32 if kind == "int32" else 64
        raw &= (1 << bits) - 1
        return raw - (1 << bits) if raw >> bits - 1 else raw
    if kind in ("sint32", "sint64"):
        return (raw >> 1) ^ -(raw & 1)
    if kind == "uint32":
        return raw & 0xFFFFFFFF
    if kind == "bool":
        return bool(raw)
    return raw.decode("utf-8", "replace") if kind == "string" else raw


def _default(kind: str):
    return {"string": "", "bytes": b"", "bool": False, "double": 0.0, "float": 0.0}.get(kind, 0)


class Decoder:
    """Wire format of a message to a dict by field name; oneofs become JSON of the member that is set."""

    def __init__(self, pool: Pool, message: str | None = None):
        self.pool, self.top = pool, pool.message(message)
        self._fields = {n: m.by_number() for n, m in pool.messages.items()}
        self._fields |= {n: {1: ProtoField("seconds", 1, "int64"), 2: ProtoField("nanos", 2, "int32")} for n in (TIMESTAMP, DURATION)}

    def decode(self, data: bytes) -> dict:
        row = self._message(self.top.name, data)
        for oneof in dict.fromkeys(f.oneof for f in self.top.fields if f.oneof):
            members = [f for f in self.top.fields if f.oneof == oneof]
            found = next((f for f in members if f.name in row), None)
            row[f"{oneof}_json"] = json.dumps({"field": found.name, "field_number": found.number, "value": row[found.name]}, separators=(",", ":"), default=_as_json) if found else None
            for f in members:
                row.pop(f.name, None)
        return row

    def _message(self, name: str, data: bytes) -> dict:
        known, row, at = self._fields[name], {}, 0
        while at < len(data):
            tag, at = _varint(data, at)
            wire = tag & 7
            if wire == 0:
                raw, at = _varint(data, at)
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
                raw, at = data[at : at + n], at + n
            elif wire == 2:
                n, at = _varint(data, at)
                raw, at = data[at : at + n], at + n
            else:
                raise DecodeError(f"wire type {wire}")
            if at > len(data):
                raise DecodeError("a field is cut off")
            f = known.get(tag >> 3)
            if f is not None:
                self._put(row, f, raw, wire)
        if name in (TIMESTAMP, DURATION):
            return row.get("seconds", 0) * 1_000_000 + row.get("nanos", 0) // 1000
        for f in known.values():
            if f.name not in row and not f.oneof:
                if f.map_key or f.repeated:
                    row[f.name] = [] if f.repeated else {}
                elif f.optional or f.type in self._fields:
                    row[f.name] = None
                else:
                    row[f.name] = self.pool.enums[f.type].get(0, "0") if f.type in self.pool.enums else _default(f.type)
        return row

    def _put(self, row: dict, f: ProtoField, raw, wire: int) -> None:
        if f.map_key:
            entry = {1: None, 2: None}
            at = 0
            pair = {1: ProtoField("k", 1, f.map_key), 2: ProtoField("v", 2, f.type)}
            while at < len(raw):
                tag, at = _varint(raw, at)
                got: dict = {}
                if tag & 7 == 0:
                    value, at = _varint(raw, at)
                elif tag & 7 == 2:
                    n, at = _varint(raw, at)
                    value, at = raw[at : at + n], at + n
                else:
                    n = 8 if tag & 7 == 1 else 4
                    value, at = raw[at : at + n], at + n
                self._put(got, pair[tag >> 3], value, tag & 7)
                entry[tag >> 3] = next(iter(got.values()))
            key = entry[1] if entry[1] is not None else _default(f.map_key)
            value = entry[2] if entry[2] is not None else (self._message(f.type, b"") if f.type in self._fields else self._value(f.type, 0) if f.type in self.pool.enums else _default(f.type))
            row.setdefault(f.name, {})["true" if key is True else "false" if key is False else str(key)] = value
        elif f.repeated:
            many = row.setdefault(f.name, [])
            if wire == 2 and f.type not in ("string", "bytes") and f.type not in self._fields:
                at = 0
                while at < len(raw):
                    if f.type in _FIXED:
                        n = struct.calcsize(_FIXED[f.type])
                        value, at = raw[at : at + n], at + n
                    else:
                        value, at = _varint(raw, at)
                    many.append(self._value(f.type, value))
            else:
                many.append(self._value(f.type, raw))
        else:
            row[f.name] = self._value(f.type, raw)

    def _value(self, kind: str, raw):
        if kind in self._fields:
            return self._message(kind, raw)
        if kind in self.pool.enums:
            number = _scalar("int32", raw)
            return self.pool.enums[kind].get(number, str(number))
        return _scalar(kind, raw)


def _as_json(x):
    return base64.b64encode(x).decode() if isinstance(x, bytes) else str(x)


def _type_of(f: ProtoField, pool: Pool, seen: tuple[str, ...] = ()) -> T.DataType:
    if f.type in pool.messages:
        if f.type in seen:
            raise ConfigError(f"{f.type} holds itself")
        kind = T.StructType([T.StructField(x.name, _type_of(x, pool, (*seen, f.type))) for x in pool.messages[f.type].fields])
    else:
        kind = T.TimestampType() if f.type == TIMESTAMP else T.LongType() if f.type == DURATION else T.StringType() if f.type in pool.enums else SCALARS[f.type]
    if f.map_key:
        return T.MapType(T.StringType() if f.map_key not in ("string",) else SCALARS[f.map_key], kind)
    return T.ArrayType(kind) if f.repeated else kind


def columns(pool: Pool, message: str | None = None) -> T.StructType:
    """A message's columns: fields outside oneofs, then ``<oneof>_json`` for each oneof."""
    m = pool.message(message)
    out = T.StructType()
    for f in m.fields:
        if f.oneof is None:
            out.add(f.name, _type_of(f, pool))
    for oneof in dict.fromkeys(f.oneof for f in m.fields if f.oneof):
        out.add(f"{oneof}_json", T.StringType())
    if taken := sorted(set(out.fieldNames()) & set(METADATA)):
        raise ConfigError(f"fields with the names of metadata columns: {taken}")
    return out


def fields(pool: Pool, message: str | None = None) -> list[Field]:
    """A message's fields for comparing schema versions."""
    m = pool.message(message)
    return [Field(i, f.name, _type_of(f, pool).simpleString()) for i, f in enumerate((x for x in m.fields if x.oneof is None), 1)]


def subject(strategy: str, topic: str, message: str | None) -> str:
    """The registry's subject of a topic's values."""
    if strategy == "topic_name":
        return f"{topic}-value"
    if message is None:
        raise ConfigError(f"{strategy} needs the message's name")
    if strategy == "record_name":
        return message
    if strategy == "topic_record_name":
        return f"{topic}-{message}"
    raise ConfigError(f"no strategy {strategy}")


def decode_framed(rows: DataFrame, schemas: dict[int, str | list[str]], message: str | None = None, value: str = "value") -> DataFrame:
    """rows: framed messages and any other columns.  schemas: proto3 source (or sources, with what they import) by schema id.  The columns
    of the highest id, then the other columns of rows, ``_schema_id`` and ``_message_type``; what a
    version lacks is null."""
    pool_of = lambda source: parse(*([source] if isinstance(source, str) else source))
    newest = pool_of(schemas[max(schemas)])
    name, shape = newest.message(message).name, columns(newest, message)
    rest = [f for f in rows.schema if f.name != value]
    out = T.StructType([*shape.fields, *rest, T.StructField("_schema_id", T.IntegerType()), T.StructField("_message_type", T.StringType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out])
    place = rows.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders: dict[int, tuple[Callable, set]] = {}
        for b in batches:
            ids, made = [], []
            for v in b.column(place):
                sid, _, payload = parse_frame(v.as_py())
                if sid not in decoders:
                    if sid not in schemas:
                        raise DecodeError(f"no schema {sid}")
                    pool = pool_of(schemas[sid])
                    decoders[sid] = (Decoder(pool, message).decode, set(columns(pool, message).fieldNames()))
                decode, own = decoders[sid]
                row = decode(payload)
                made.append({n: row.get(n) for n in shape.fieldNames() if n in own})
                ids.append(sid)
            user = [pa.array([_cells(r.get(f.name), f.dataType) for r in made], arrow.field(f.name).type) for f in shape]
            others = [b.column(i) for i, n in enumerate(b.schema.names) if i != place]
            yield pa.RecordBatch.from_arrays([*user, *others, pa.array(ids, pa.int32()), pa.array([name] * len(ids))], schema=arrow)

    return rows.mapInArrow(run, out)


def _cells(x, kind: T.DataType):
    """A decoded value as Arrow takes it: decimals for unsigned longs, pairs for maps."""
    if x is None:
        return None
    if isinstance(kind, T.DecimalType):
        from decimal import Decimal

        return Decimal(x)
    if isinstance(kind, T.MapType):
        return [(k, _cells(v, kind.valueType)) for k, v in x.items()]
    if isinstance(kind, T.ArrayType):
        return [_cells(v, kind.elementType) for v in x]
    if isinstance(kind, T.StructType):
        return {f.name: _cells(x.get(f.name), f.dataType) for f in kind}
    return x


def encode_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def frame(schema_id: int, payload: bytes) -> bytes:
    """A framed message of the schema's first message."""
    return b"\0" + schema_id.to_bytes(4, "big") + b"\0" + payload
