import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.functions import keys, values


@pytest.mark.parametrize(
    "raw, as_int, as_float",
    [("12abc", 0, 0.0), ("3.7", 3, 3.7), ("-3.7", -3, -3.7), ("", 0, 0.0), ("x", 0, 0.0), ("41", 41, 41.0), (None, 0, 0.0)],
)
def test_normalize_reads_numbers(spark, raw, as_int, as_float):
    df = spark.createDataFrame([(raw,)], "v string")
    row = df.select(keys.normalize(F.col("v"), "int").alias("i"), keys.normalize(F.col("v"), "float").alias("f")).first()
    assert (row.i, row.f) == (as_int, as_float)
    if raw is not None:
        assert keys.python_key(raw, "int") == as_int
        assert keys.python_key(raw, "float") == as_float


def test_long_keys_keep_their_digits(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big,)], "v long")
    assert df.select(keys.normalize(F.col("v"), "int", T.LongType()).alias("k")).first().k == big


@pytest.mark.parametrize(
    "mode, value, text",
    [
        ("int", 42, "n>42"),
        ("float", 20.5, "n>20.5"),
        ("float", 20.0, "n>20"),
        ("buffer", b"\x00\xff", "b>00ff"),
        ("string", "user:1", "user:1"),
        ("any", 7, "n>7"),
        ("any", "n", "s>n"),
        ("any", b"\x01", "b>01"),
    ],
)
def test_encode_and_decode(spark, mode, value, text):
    one = spark.range(1).select(keys.literal(value, mode).alias("k"))
    row = one.select(keys.encode(F.col("k"), mode).alias("e")).first()
    assert row.e == text
    back = one.select(keys.decode(keys.encode(F.col("k"), mode), mode).alias("d")).first().d
    assert keys.plain_key(back, mode) == value


def test_any_keys_order_numbers_strings_bytes(spark):
    given = ["b", b"\x01", 10, "a", 2.5, b"\x00", -3]
    df = spark.createDataFrame([(keys.python_key(k, "any"),) for k in given], T.StructType([T.StructField("key", keys.ANY)]))
    assert [keys.plain_key(r.key, "any") for r in df.orderBy("key").collect()] == [-3, 2.5, 10, "a", "b", b"\x00", b"\x01"]


def test_refused_keys_and_values():
    with pytest.raises(ValueError, match="Key can't be null or undefined!"):
        keys.python_key(None, "int")
    with pytest.raises(ValueError):
        keys.python_key(float("nan"), "any")
    with pytest.raises(ValueError, match="Data must be a string or Buffer!"):
        values.check_value(3)
    with pytest.raises(ValueError):
        keys.key_type("uuid")


def test_value_codec(spark):
    one = spark.createDataFrame([(bytearray(b"\x00\x01\xfe"),)], "v binary")
    row = one.select(values.encode_value(F.col("v")).alias("e")).first().e
    assert row.type == 1
    back = spark.createDataFrame([(row.data,)], "d string").select(values.decode_value(F.col("d")).alias("v")).first().v
    assert bytes(back) == b"\x00\x01\xfe"
