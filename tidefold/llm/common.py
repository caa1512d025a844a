"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One step of a multiplicative 64-bit mixer (odd constants from the golden ratio).
_MUL_A = np.uint64(0x9E3779B97F4A7C15)
_MUL_B = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_S29 = np.uint64(29)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, pa.Array]], dict], schema: str, text_bytes: int | None = None, column: str = "text"
) -> DataFrame:
    """Run ``fn`` on every Arrow batch of ``df``.

    ``fn`` gets a dict of column arrays and returns a dict of arrays or lists in
    the order of ``schema``; the number of rows may change. With ``text_bytes``
    it gets so much of ``column`` at a time, or one longer row.
    """
    target = _arrow_schema(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_bytes, column):
            cols = dict(zip(batch.schema.names, batch.columns))
            out = fn(cols)
            arrays = [
                v if isinstance(v, pa.Array) else pa.array(v, type=target.field(k).type)
                for k, v in out.items()
            ]
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target)],
                schema=target,
            )

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Have the session send Python batches of a few MB, not of 10,000 rows of any length.

    Results don't depend on it; a smaller setting of the user's stays.
    """
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.sub("[bB]$", "", str(spark.conf.get(name)))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def pieces(batches: Iterator[pa.RecordBatch], text_bytes: int | None, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` has ``text_bytes`` at most, or is one row."""
    for batch in batches:
        if text_bytes is None or not batch.num_rows:
            yield batch
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        upto = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = int(upto[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(upto, done + text_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def map_same(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], text_bytes: int) -> DataFrame:
    """Run ``fn``, which keeps the columns, on pieces of ``df`` of so much ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_bytes):
            yield fn(piece)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets everything once it holds ``limit`` words."""

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    x = a * _MUL_A
    x ^= x >> _S32
    x += b
    x *= _MUL_B
    x ^= x >> _S29
    x *= _MUL_A
    x ^= x >> _S32
    return x


def span_hash(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of ``h[i:i+width]`` for every i, by doubling; length ``len(h)-width+1``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, level = None, 0, 1, h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    while True:
        if width & power:
            part = level[done : done + n]
            out = part.copy() if out is None else mix(out, part)
            done += power
        power *= 2
        if power > width:
            return mix(out, np.uint64(width + seed))
        level = mix(level[: len(level) - power // 2], level[power // 2 :])


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at just these bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared checkpoint folder and read it.

    The folder is ``spark.checkpoint.dir``; where that is unset, a temporary one
    is made (single-machine tests only). The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_folder, "local"):
        import atexit
        import shutil
        import tempfile

        shared_folder.local = tempfile.mkdtemp(prefix="tidefold-")
        atexit.register(shutil.rmtree, shared_folder.local, ignore_errors=True)
    return f"file://{shared_folder.local}"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now.

    They go when the driver collects the garbage that refers to them, which a
    driver with little to do may not do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(df: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b).

    Alternating large-star and small-star steps; each is a grouped minimum, so a
    hub is combined map-side. Stops when a round changes nothing. Vertices
    without an edge are their own component.
    """
    cur = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    last = None
    while True:
        # Large-star: every larger neighbour of u is linked to u's smallest neighbour.
        both = cur.select("a", "b").union(cur.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small-star: u's smaller neighbours and u itself are linked to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("x"), "m")
            .union(least.select(F.col("a").alias("x"), "m"))
            .where("x <> m")
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        new = cut_lineage(small)
        stat = new.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        drop_folder(cur)
        cur = new
        if tuple(stat) == last:
            break
        last = tuple(stat)
    roots = cur.groupBy("a").agg(F.min("b").alias("component"))
    return vertices.select("id").join(roots, vertices["id"] == roots["a"], "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
