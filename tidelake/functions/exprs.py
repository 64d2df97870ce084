"""Scalar expressions of the engine, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_size(key: Column, value: Column, topic: Column, headers: Column | None = None) -> Column:
    """Bytes that a message takes: its parts and 24 for the numbers; nulls count as empty."""
    size = F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0)) + F.octet_length(topic) + 24
    if headers is not None:
        each = lambda s, h: s + F.octet_length(h["key"]) + F.coalesce(F.octet_length(h["value"]), F.lit(0))
        size = size + F.coalesce(F.aggregate(headers, F.lit(0), each), F.lit(0))
    return size.cast("long")


def headers_without_nulls(headers: Column) -> Column:
    """Headers with empty bytes for null values."""
    return F.transform(headers, lambda h: F.struct(h["key"].alias("key"), F.coalesce(h["value"], F.lit(b"")).alias("value")))


def utf8_or_null(data: Column) -> Column:
    """Bytes as text, null where they aren't UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def time_bucket(ms: Column, hourly: bool = False) -> Column:
    """The UTC day or hour of a time in milliseconds, as text."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd-HH" if hourly else "yyyy-MM-dd")


def transform_year(ms: Column) -> Column:
    return (F.year(F.timestamp_millis(ms)) - 1970).cast("int")


def transform_month(ms: Column) -> Column:
    t = F.timestamp_millis(ms)
    return ((F.year(t) - 1970) * 12 + F.month(t) - 1).cast("int")


def transform_day(ms: Column) -> Column:
    return F.floor(ms / 86_400_000).cast("int")


def transform_hour(ms: Column) -> Column:
    return F.floor(ms / 3_600_000).cast("int")


def transform_truncate(x: Column, width: int, text: bool = False) -> Column:
    return F.substring(x, 1, width) if text else x - F.pmod(x, F.lit(width))


def _u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _rotl32(x: Column, n: int) -> Column:
    return _u32(F.shiftleft(x, n)).bitwiseOR(F.shiftright(x, 32 - n))


def _times(a: Column, factor: int) -> Column:
    """a times a 32-bit factor modulo 2^32, by halves so that no long overflows."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return _u32(low * F.lit(factor) + F.shiftleft(_u32(high * F.lit(factor)), 16))


def murmur3_long(x: Column) -> Column:
    """The 32-bit x86 Murmur3 hash with seed 0 of a long's eight little-endian bytes."""
    h = F.lit(0).cast("long")
    for word in (_u32(x), F.shiftrightunsigned(x, 32)):
        k = _times(_rotl32(_times(word, 0xCC9E2D51), 15), 0x1B873593)
        h = _u32(_rotl32(h.bitwiseXOR(k), 13) * 5 + F.lit(0xE6546B64))
    h = h.bitwiseXOR(F.lit(8).cast("long"))
    h = _times(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = _times(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


def transform_bucket(x: Column, buckets: int) -> Column:
    """The bucket of a whole number: its Murmur3 hash, made non-negative, modulo the number."""
    return (murmur3_long(x.cast("long")).bitwiseAND(F.lit(0x7FFFFFFF)) % buckets).cast("int")


def backoff_ms(attempt: Column, base: int = 100, most: int = 30_000) -> Column:
    """The wait before a retry: doubled each time, at most ``most``."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(20)))).cast("long")


def file_crc32(content: Column) -> Column:
    """CRC-32 of bytes as eight hex digits."""
    return F.lower(F.lpad(F.hex(F.crc32(content)), 8, "0"))


def frame_schema_id(value: Column) -> Column:
    """The schema id of a framed message (0, big-endian id, message path, payload), null if it isn't one."""
    fine = (F.octet_length(value) >= 6) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(fine, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long"))


def looks_like(text: Column) -> Column:
    """``timestamptz``, ``date``, ``uuid`` or ``string``, tested in that order."""
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), "timestamptz")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(text.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "uuid")
        .otherwise("string")
    )
