"""Key modes as Spark types, their normalisation and their text encoding.

Modes: ``string``, ``int``, ``float``, ``buffer`` and ``any``. An ``any`` key is a
struct (kind, num, str, bin) whose natural order puts numbers before strings
before bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import messages

MODES = ("string", "int", "float", "buffer", "any")
ANY = T.StructType(
    [
        T.StructField("kind", T.ByteType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("str", T.StringType()),
        T.StructField("bin", T.BinaryType()),
    ]
)
_TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "buffer": T.BinaryType(), "any": ANY}
#: Kinds of ``any`` keys in order, and their prefixes in encoded keys.
NUMBER, STRING, BYTES = 0, 1, 2
PREFIX = {NUMBER: "n>", STRING: "s>", BYTES: "b>"}


def key_type(mode: str) -> T.DataType:
    if mode not in _TYPES:
        raise ValueError(f"unknown key mode {mode!r}; one of {', '.join(MODES)}")
    return _TYPES[mode]


def any_key(kind: int, value: Column) -> Column:
    """An ``any`` key of one kind from a plain column."""
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit(kind).cast("tinyint").alias("kind"),
        (value.cast("double") if kind == NUMBER else null("double")).alias("num"),
        (value.cast("string") if kind == STRING else null("string")).alias("str"),
        (value.cast("binary") if kind == BYTES else null("binary")).alias("bin"),
    )


def normalize(value: Column, mode: str, source: T.DataType | None = None) -> Column:
    """``value`` as a key of ``mode``.

    ``int`` and ``float`` read numbers from text; what can't be read becomes 0,
    and ``int`` cuts towards zero and to 64 bits. ``any`` needs the type of the source column.
    """
    if mode == "string":
        return value.cast("string")
    if mode in ("int", "float"):
        number = value.try_cast("double")
        safe = F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)
        if mode == "float":
            return safe
        # Long sources keep all their digits.
        cut = F.when(safe < 0, F.ceil(safe)).otherwise(F.floor(safe)).cast("long")
        return F.coalesce(value.cast("long"), F.lit(0).cast("long")) if isinstance(source, T.IntegralType) else cut
    if mode == "buffer":
        return value.cast("binary")
    if isinstance(source, T.StructType):
        return value.cast(ANY)
    if isinstance(source, T.NumericType):
        return any_key(NUMBER, value)
    return any_key(BYTES if isinstance(source, T.BinaryType) else STRING, value)


def python_key(value, mode: str):
    """A Python value as a key of ``mode``; a tuple (kind, num, str, bin) for ``any``.

    As ``normalize``: ``int`` keys end at 64 bits. Raises ValueError for None and,
    where order needs a number, for NaN.
    """
    if value is None:
        raise ValueError(messages.NULL_KEY)
    if isinstance(value, bytearray | memoryview):
        value = bytes(value)
    if mode == "string":
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if mode in ("int", "float"):
        whole = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
        if mode == "int" and isinstance(value, int):
            return whole(int(value))
        try:
            number = float(value)
        except OverflowError:
            number = math.inf if value > 0 else -math.inf
        except (TypeError, ValueError):
            return 0 if mode == "int" else 0.0
        if mode == "float":
            return 0.0 if math.isnan(number) else number
        if math.isnan(number):
            return 0
        return whole(int(number)) if math.isfinite(number) else whole(1 << 64 if number > 0 else -(1 << 64))
    if mode == "buffer":
        return value if isinstance(value, bytes) else str(value).encode()
    if isinstance(value, bytes):
        return (BYTES, None, None, value)
    if isinstance(value, int | float) and not isinstance(value, bool):
        if math.isnan(value):
            raise ValueError("NaN can't be a key")
        return (NUMBER, float(value), None, None)
    return (STRING, None, str(value), None)


def plain_key(value, mode: str):
    """The Python value of a collected key."""
    if mode == "any":
        if value is None:
            return None
        if value["kind"] == NUMBER:
            n = value["num"]
            return int(n) if n.is_integer() else n
        return value["str"] if value["kind"] == STRING else bytes(value["bin"])
    return bytes(value) if mode == "buffer" and value is not None else value


def literal(value, mode: str) -> Column:
    """A normalised Python key as a literal column."""
    k = python_key(value, mode)
    if mode != "any":
        return F.lit(k).cast(key_type(mode))
    return any_key(k[0], F.lit(k[1 + k[0]]))


def bound(key: Column, test: str, value, mode: str) -> Column:
    """``key`` compared (eq, ge, gt, le or lt) with a Python key.

    Of ``any`` keys the parts are compared too: that is implied, and unlike a
    comparison of whole structs it reaches the files.
    """
    compare = {"eq": "__eq__", "ge": "__ge__", "gt": "__gt__", "le": "__le__", "lt": "__lt__"}[test]
    whole = getattr(key, compare)(literal(value, mode))
    if mode != "any":
        return whole
    kind, *parts = python_key(value, mode)
    if test == "eq":
        return (key["kind"] == F.lit(kind).cast("tinyint")) & (key[("num", "str", "bin")[kind]] == F.lit(parts[kind])) & whole
    return getattr(key["kind"], "__ge__" if test[0] == "g" else "__le__")(F.lit(kind).cast("tinyint")) & whole


def within(key: Column, lo, hi, mode: str) -> Column:
    """``key`` from lo to hi, both included."""
    both = bound(key, "ge", lo, mode) & bound(key, "le", hi, mode)
    if mode != "any":
        return both
    (a, *low), (b, *high) = python_key(lo, mode), python_key(hi, mode)
    part = key[("num", "str", "bin")[a]]
    return (part >= F.lit(low[a])) & (part <= F.lit(high[b])) & both if a == b else both


def _number_text(num: Column) -> Column:
    """Whole numbers without a decimal point, others in their shortest form."""
    whole = (num == F.floor(num)) & (F.abs(num) < F.lit(float(1 << 63)))
    return F.when(whole, num.cast("decimal(20,0)").cast("string")).otherwise(num.cast("string"))


def encode(key: Column, mode: str) -> Column:
    """Keys as text; numbers, strings and bytes stay apart in ``any`` mode."""
    if mode == "string":
        return key
    if mode == "int":
        return F.concat(F.lit("n>"), key.cast("string"))
    if mode == "float":
        return F.concat(F.lit("n>"), _number_text(key))
    if mode == "buffer":
        return F.concat(F.lit("b>"), F.lower(F.hex(key)))
    return (
        F.when(key["kind"] == NUMBER, F.concat(F.lit("n>"), _number_text(key["num"])))
        .when(key["kind"] == STRING, F.concat(F.lit("s>"), key["str"]))
        .otherwise(F.concat(F.lit("b>"), F.lower(F.hex(key["bin"]))))
    )


def decode(text: Column, mode: str) -> Column:
    """The inverse of ``encode``; text without a known prefix is a string."""
    head, body = F.substring(text, 1, 2), F.substring(text, 3, F.length(text))
    if mode == "string":
        return text
    if mode in ("int", "float"):
        return F.when(head == "n>", body).otherwise(text).try_cast(key_type(mode))
    if mode == "buffer":
        return F.when(head == "b>", F.unhex(body)).otherwise(text.cast("binary"))
    return (
        F.when(head == "n>", any_key(NUMBER, body.try_cast("double")))
        .when(head == "b>", any_key(BYTES, F.unhex(body)))
        .otherwise(any_key(STRING, F.when(head == "s>", body).otherwise(text)))
    )
