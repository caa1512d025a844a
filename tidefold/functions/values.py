"""Value codecs and record checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import messages
from .keys import encode

#: Type tags of stored values.
TEXT, DATA = 0, 1


def encode_value(data: Column) -> Column:
    """struct(data, type): bytes as base64 with their type tag."""
    return F.struct(F.base64(data).alias("data"), F.lit(DATA).alias("type"))


def decode_value(data: Column) -> Column:
    return F.unbase64(data)


def digest(value: Column) -> Column:
    """SHA-1 of text or bytes, as lowercase hex."""
    return F.sha1(value.cast("binary"))


def record_crc(key: Column, mode: str, value: Column, data: Column) -> Column:
    """Checksum of one put: encoded key, then text or bytes."""
    none = F.lit(b"").cast("binary")
    return F.crc32(
        F.concat(
            encode(key, mode).cast("binary"),
            F.lit(b"\x00").cast("binary"),
            F.coalesce(value.cast("binary"), data, none),
        )
    )


def intact(key: Column, mode: str, op: Column, value: Column, data: Column, crc: Column) -> Column:
    """Whether a log record is as it was written; only puts carry a checksum."""
    return (op != "put") | (crc == record_crc(key, mode, value, data))


def check_value(value) -> tuple[str | None, bytes | None, int]:
    """(text, bytes, type tag) of a Python value."""
    if isinstance(value, str):
        return value, None, TEXT
    if isinstance(value, bytes | bytearray | memoryview):
        return None, bytes(value), DATA
    raise ValueError(messages.BAD_VALUE)
