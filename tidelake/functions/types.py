"""Table types as text, as Spark types, and as other catalogs name them."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

from tidelake.errors import SchemaError

#: Names of primitive table types, and aliases.
PRIMITIVES = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "time": T.StringType(), "uuid": T.StringType(), "timestamp_ns": T.LongType(), "timestamptz_ns": T.LongType(),
}
ALIASES = {"bool": "boolean", "integer": "int", "bigint": "long", "utf8": "string", "bytes": "binary"}
HIVE = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "boolean": "boolean", "float": "float", "double": "double", "string": "string", "binary": "binary", "date": "date", "timestamp": "timestamptz", "decimal": "decimal(38, 18)"}
TO_HIVE = {"int": "int", "long": "bigint", "timestamptz": "timestamp", "time": "string", "uuid": "string", "timestamp_ns": "bigint", "timestamptz_ns": "bigint"}
_DECIMAL, _FIXED = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)"), re.compile(r"fixed\[(\d+)\]")


def parse(text) -> T.DataType:
    """Spark's type of a table type: a name, or the JSON of a struct, list or map."""
    if isinstance(text, str) and text.lstrip().startswith("{"):
        text = json.loads(text)
    if isinstance(text, dict):
        kind = text.get("type")
        if kind == "struct":
            return T.StructType([T.StructField(f["name"], parse(f["type"]), not f.get("required", False), {"id": f["id"]} if "id" in f else None) for f in text["fields"]])
        if kind == "list":
            return T.ArrayType(parse(text["element"]), not text.get("element-required", False))
        if kind == "map":
            return T.MapType(parse(text["key"]), parse(text["value"]), not text.get("value-required", False))
        raise SchemaError(f"no type {kind}")
    name = ALIASES.get(text.lower(), text.lower())
    if name in PRIMITIVES:
        return PRIMITIVES[name]
    if m := _DECIMAL.fullmatch(name):
        return T.DecimalType(int(m[1]), int(m[2]))
    if _FIXED.fullmatch(name):
        return T.BinaryType()
    raise SchemaError(f"no type {text}")


def text_of(kind: T.DataType, ids: list[int] | None = None):
    """The table type of a Spark type: a name, or a dict with ids counted on."""
    ids = ids if ids is not None else [0]

    def next_id() -> int:
        ids[0] += 1
        return ids[0]

    if isinstance(kind, T.StructType):
        numbered = [(next_id(), f) for f in kind]
        return {"type": "struct", "fields": [{"id": i, "name": f.name, "required": not f.nullable, "type": text_of(f.dataType, ids)} for i, f in numbered]}
    if isinstance(kind, T.ArrayType):
        return {"type": "list", "element-id": next_id(), "element": text_of(kind.elementType, ids), "element-required": not kind.containsNull}
    if isinstance(kind, T.MapType):
        k, v = next_id(), next_id()
        return {"type": "map", "key-id": k, "key": text_of(kind.keyType, ids), "value-id": v, "value": text_of(kind.valueType, ids), "value-required": not kind.valueContainsNull}
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision}, {kind.scale})"
    if isinstance(kind, (T.ShortType, T.ByteType)):
        return "int"
    found = next((n for n, t in PRIMITIVES.items() if t == kind), None)
    if found is None:
        raise SchemaError(f"no table type for {kind.simpleString()}")
    return found


def from_hive(text: str) -> str:
    """A table type's name for one of Hive or Glue."""
    name = text.strip().lower()
    if m := re.fullmatch(r"(?:var)?char\(\d+\)", name):
        return "string" if m else name
    if m := re.fullmatch(r"array<(.*)>", name):
        return f"list<{from_hive(m[1])}>"
    if _DECIMAL.fullmatch(name):
        return name
    if name not in HIVE:
        raise SchemaError(f"no type for {text}")
    return HIVE[name]


def to_hive(text: str) -> str:
    name = ALIASES.get(text, text)
    if m := _FIXED.fullmatch(name):
        return "binary" if m else name
    return TO_HIVE.get(name, name)
