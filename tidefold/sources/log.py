"""Log and segment files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_type
from ..functions.values import intact, record_crc


def key_leaves(mode: str) -> list[str]:
    """Parquet columns of a key."""
    kind = key_type(mode)
    return [f"key.{f.name}" for f in kind] if isinstance(kind, T.StructType) else ["key"]


def log_schema(mode: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("ord", T.LongType()),
            T.StructField("tx", T.LongType()),
            T.StructField("op", T.StringType()),
            T.StructField("key", key_type(mode)),
            T.StructField("value", T.StringType()),
            T.StructField("data", T.BinaryType()),
            T.StructField("crc", T.LongType()),
        ]
    )


def segment_schema(mode: str) -> T.StructType:
    return T.StructType([f for f in log_schema(mode) if f.name not in ("tx", "crc")])


def read_log(spark: SparkSession, paths: list[str], mode: str) -> DataFrame:
    """Log records of these batches, without those whose checksum is wrong."""
    schema = log_schema(mode)
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.where(
        intact(F.col("key"), mode, F.col("op"), F.col("value"), F.col("data"), F.col("crc")) | F.col("key").isNull()
    )


def read_segments(spark: SparkSession, paths: list[str], mode: str) -> DataFrame:
    schema = segment_schema(mode)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def with_crc(rows: DataFrame, mode: str) -> DataFrame:
    return rows.withColumn(
        "crc", F.when(F.col("op") == "put", record_crc(F.col("key"), mode, F.col("value"), F.col("data")))
    ).select(*log_schema(mode).names)
