"""Streams over the log: the folded state, change feeds and ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fold
from ..sources.log import log_schema


def log_stream(spark: SparkSession, path: str, mode: str, per_trigger: int | None = None) -> DataFrame:
    """New log batches of a store's folder as they appear."""
    reader = spark.readStream.schema(log_schema(mode)).option("recursiveFileLookup", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{path.rstrip('/')}/log")


def latest_state(records: DataFrame, order: str = "seq", carry: tuple[str, ...] = ("value",)) -> DataFrame:
    """The fold as a stream (complete or update mode): one row of state a key.

    Rows outside transactions only; see ``follow`` for those inside.
    """
    by = F.struct("seq", "ord") if "ord" in records.columns else F.col(order)
    return fold.newest(records, ["key"], by, ["op", *carry])


def change_feed(
    records: DataFrame, on_changes: Callable[[DataFrame, int], None], checkpoint: str, **options
) -> StreamingQuery:
    """Call ``on_changes(changes, batch)`` with the newest record of each key that a micro-batch touched."""

    def each(batch: DataFrame, number: int) -> None:
        on_changes(latest_state(batch, carry=tuple(c for c in batch.columns if c not in ("key", "op"))), number)

    return _start(records.writeStream.foreachBatch(each), checkpoint, options)


def ingest(rows: DataFrame, store, checkpoint: str, **options) -> StreamingQuery:
    """Write a stream of (key, value[, op, ord]) to a store, each micro-batch atomically.

    A micro-batch that is run again after a crash writes the same keys and
    values again, which leaves the state as it is.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.put_many(batch)

    return _start(rows.writeStream.foreachBatch(each), checkpoint, options)


def follow(records: DataFrame, on_changes: Callable[[DataFrame, int], None], held: str, checkpoint: str, **options) -> StreamingQuery:
    """A change feed of committed records, transactions included.

    Records of a transaction that has no outcome yet are held in the folder
    ``held`` (one sub-folder a micro-batch) and read again with the next
    micro-batches, until its commit or abort record comes.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = f"{held.rstrip('/')}/{number - 1}"
        rows = batch
        if number and _there(spark, waiting):
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(waiting))
        ended = rows.where(F.col("op").isin(fold.COMMIT, fold.ABORT)).select("tx").distinct()
        rows.where("tx is not null").join(ended, "tx", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(
            f"{held.rstrip('/')}/{number}"
        )
        done = fold.committed(rows)
        on_changes(latest_state(done, carry=tuple(c for c in done.columns if c not in ("key", "op"))), number)

    return _start(records.writeStream.foreachBatch(each), checkpoint, options)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _start(writer, checkpoint: str, options: dict) -> StreamingQuery:
    trigger = options or {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
