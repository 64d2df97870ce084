"""Schemas: inference from JSON, comparison, and additive evolution."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.errors import SchemaError
from tidelake.functions.exprs import looks_like

#: Which type may become which, and which type holds another's values.
PROMOTIONS = {"int": ("long", "float", "double"), "float": ("double",), "long": ("double",)}
HOLDS = {"long": ("int",), "double": ("float", "int", "long"), "float": ("int",)}
TYPES = ("boolean", "int", "long", "float", "double", "string", "date", "timestamptz", "uuid")
#: New fields of one evolution, at most.
MOST_NEW = 50


def can_promote(a: str, b: str) -> bool:
    return a == b or b == "string" or b in PROMOTIONS.get(a, ())


def fits(value: str, column: str) -> bool:
    """Whether a column holds the values of another type."""
    return value == column or column == "string" or value in HOLDS.get(column, ())


def promotion_matrix(spark: SparkSession) -> DataFrame:
    """Every pair of types: whether it is a safe promotion, and whether the second holds the first."""
    rows = [(a, b, can_promote(a, b), fits(a, b)) for a in TYPES for b in TYPES]
    return spark.createDataFrame(rows, "from_type string, to_type string, promotes boolean, fits boolean")


def _value_type(v: Column, text: Column) -> Column:
    """A JSON value's type, from its variant and its text."""
    kind = F.schema_of_variant(v)
    whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    number = text.try_cast("decimal(38,0)")
    return (
        F.when(kind == "BOOLEAN", "boolean")
        .when(whole & number.between(-(2**31), 2**31 - 1), "int").when(whole, "long")
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "double")
        .when(kind == "STRING", looks_like(text)).when(kind == "VOID", F.lit(None).cast("string")).otherwise("string")
    )


def json_values(rows: DataFrame, json: str) -> DataFrame:
    """Each field of each JSON object: ``name``, ``type`` (null for a JSON null)."""
    fields = rows.select(F.explode(F.json_object_keys(json)).alias("name"), F.parse_json(json).alias("v"))
    path = F.concat(F.lit("$['"), F.col("name"), F.lit("']"))
    value = F.try_variant_get("v", path, "variant")
    return fields.select("name", _value_type(value, F.try_variant_get("v", path, "string")).alias("type"))


def resolve(kinds: Column) -> Column:
    """One type for a set of types: double, float with whole numbers, float, long, int, else the only
    one, else string."""
    has = lambda t: F.array_contains(kinds, t)
    whole = has("int") | has("long")
    return (
        F.when(has("double") | (has("float") & whole), "double").when(has("float"), "float").when(has("long") | (has("int") & (F.size(kinds) > 1)), "long")
        .when(F.size(kinds) == 1, kinds[0]).otherwise("string")
    )


def infer(rows: DataFrame, json: str = "value") -> DataFrame:
    """``name``, ``type``, ``required`` of the fields of JSON objects; a field is required if all
    objects have it and none as null.  Fields that are only null are strings."""
    n = rows.filter(F.col(json).isNotNull()).agg(F.count("*").alias("n"))
    stats = json_values(rows, json).groupBy("name").agg(F.count("*").alias("seen"), F.count_if(F.col("type").isNull()).alias("nulls"), F.sort_array(F.collect_set("type")).alias("kinds"))
    return stats.join(F.broadcast(n)).select("name", resolve(F.col("kinds")).alias("type"), ((F.col("seen") == F.col("n")) & (F.col("nulls") == 0)).alias("required"), "seen", "nulls")


def diff(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both: ``name``, ``type``, ``required``.  ``change`` for each field: ``added``, ``removed``,
    ``fits``, ``promoted``, ``incompatible``, ``requiredness``, ``same``, and whether it is breaking."""
    a = existing.select("name", F.col("type").alias("old_type"), F.col("required").alias("old_required"))
    b = incoming.select("name", F.col("type").alias("new_type"), F.col("required").alias("new_required"))
    matrix = promotion_matrix(existing.sparkSession).select(F.col("from_type"), F.col("to_type"), "promotes", "fits")
    held, grown = matrix.select(F.col("from_type").alias("new_type"), F.col("to_type").alias("old_type"), "fits"), matrix.select(F.col("from_type").alias("old_type"), F.col("to_type").alias("new_type"), "promotes")
    both = a.join(b, "name", "full_outer").join(F.broadcast(held), ["new_type", "old_type"], "left").join(F.broadcast(grown), ["old_type", "new_type"], "left")
    change = (
        F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when((F.col("old_type") == F.col("new_type")) & (F.col("old_required") != F.col("new_required")), "requiredness")
        .when(F.col("old_type") == F.col("new_type"), "same").when(F.coalesce("fits", F.lit(False)), "fits").when(F.coalesce("promotes", F.lit(False)), "promoted").otherwise("incompatible")
    )
    breaking = (change == "incompatible") | (change == "removed") | ((change == "added") & F.coalesce("new_required", F.lit(False))) | (change == "requiredness")
    return both.select("name", "old_type", "new_type", change.alias("change"), breaking.alias("breaking"))


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: object
    required: bool = False
    doc: str | None = None


@dataclass(frozen=True)
class TableSchema:
    schema_id: int
    fields: tuple[Field, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class FieldsDiff:
    """What incoming fields add, and what makes them unfit."""

    added: tuple[Field, ...]
    breaking: tuple[str, ...]


def same_type(a, b) -> bool:
    """Types are equal but for ids and docs in nested ones."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if k not in ("id", "element-id", "key-id", "value-id", "doc")}
        return [bare(v) for v in x] if isinstance(x, list) else x

    return bare(a) == bare(b)


def diff_fields(existing: TableSchema, incoming: list[Field], allow_missing: bool = False) -> FieldsDiff:
    """allow_missing: incoming is an older version of the schema, whose missing fields become null."""
    old, new = {f.name: f for f in existing.fields}, {f.name: f for f in incoming}
    added, breaking = [], []
    for f in incoming:
        had = old.get(f.name)
        if had is None:
            (breaking.append(f"new required field '{f.name}'") if f.required else added.append(f))
        elif not same_type(had.type, f.type):
            breaking.append(f"field '{f.name}' changed type from {had.type} to {f.type}")
        elif had.required != f.required:
            breaking.append(f"field '{f.name}' changed required from {had.required} to {f.required}")
    if not allow_missing:
        breaking += [f"field '{n}' was removed" for n in old if n not in new]
    return FieldsDiff(tuple(added), tuple(breaking))


def evolve(existing: TableSchema, added: list[Field], most: int = MOST_NEW) -> TableSchema:
    """The schema with optional fields added, their ids counted on from the largest."""
    if len(added) > most:
        raise SchemaError(f"{len(added)} new fields; at most {most} are taken at once")
    top = max((f.id for f in existing.fields), default=0)
    new = tuple(Field(top + i, f.name, f.type, False, f.doc) for i, f in enumerate(added, 1))
    return TableSchema(existing.schema_id + 1, existing.fields + new)


def mismatches(table: DataFrame, incoming: DataFrame) -> list[tuple[str, str]]:
    """How a DataFrame's columns differ from a table's: (kind, column)."""
    a, b = {f.name: f for f in table.schema}, {f.name: f for f in incoming.schema}
    out = [("missing", n) for n in a if n not in b] + [("extra", n) for n in b if n not in a]
    out += [("type", n) for n in a if n in b and a[n].dataType != b[n].dataType]
    return out + [("nullability", n) for n in a if n in b and a[n].dataType == b[n].dataType and b[n].nullable and not a[n].nullable]
