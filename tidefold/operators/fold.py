"""Folding a log of puts and deletes to its newest committed state.

All functions are DataFrame -> DataFrame and lazy. The fold keeps one aggregate
per carried column, so that a scan which needs only keys reads only keys,
versions and ops, and key filters pass through it down to the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PUT, DELETE, COMMIT, ABORT = "put", "del", "commit", "abort"


def newest(records: DataFrame, keys: list[str], order: Column, carry: list[str]) -> DataFrame:
    """For each key the carried columns of its record of greatest ``order``."""
    aggs = [F.max_by(c, order).alias(c) for c in carry]
    return records.groupBy(*keys).agg(*aggs)


def fold(
    records: DataFrame, order: Column | str = "seq", carry: list[str] | None = None, tombstones: bool = False
) -> DataFrame:
    """Newest record of each ``key``; deleted keys only where ``tombstones`` asks for them.

    ``records`` has key, op and the carried columns (all others by default).
    """
    order = F.col(order) if isinstance(order, str) else order
    carry = [c for c in records.columns if c not in ("key", "op")] if carry is None else carry
    state = newest(records, ["key"], order, ["op", *carry])
    return state if tombstones else state.where(F.col("op") == PUT).drop("op")


def deleted(records: DataFrame, order: str = "seq") -> DataFrame:
    """Keys whose newest record is a delete, with that record's order."""
    state = newest(records, ["key"], F.col(order), ["op", order])
    return state.where(F.col("op") == DELETE).select("key", order)


def committed(log: DataFrame) -> DataFrame:
    """Puts and deletes that took effect: those outside a transaction, and those
    of a transaction with a commit record.

    ``log`` has seq, tx (null outside transactions) and op. A transaction number
    may be used again, so each record belongs to the next outcome record of its
    transaction by seq; without one it is incomplete and has no effect. The
    outcome is carried back within a transaction number only.
    """
    auto = log.where(F.col("tx").isNull() & F.col("op").isin(PUT, DELETE))
    inside = log.where(F.col("tx").isNotNull())
    after = Window.partitionBy("tx").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    ends = F.first(F.when(F.col("op").isin(COMMIT, ABORT), F.col("op")), ignorenulls=True).over(after)
    done = inside.withColumn("_end", ends).where((F.col("_end") == COMMIT) & F.col("op").isin(PUT, DELETE))
    return auto.unionByName(done.drop("_end"))


def committed_by(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """As ``committed`` where each transaction has a number of its own, with the
    outcomes in a table (tx, op).

    A semi-join on tx, no window: a transaction of any size is spread over tasks.
    """
    writes = log.where(F.col("op").isin(PUT, DELETE))
    done = outcomes.where(F.col("op") == COMMIT).select("tx")
    return writes.where(F.col("tx").isNull()).unionByName(writes.join(done, "tx", "left_semi").select(*log.columns))


def as_of(records: DataFrame, seq: int) -> DataFrame:
    """The records before ``seq``; fold them for the state at that time."""
    return records.where(F.col("seq") < F.lit(seq))


def history(records: DataFrame) -> DataFrame:
    """Every record of every key with its version number and the value before it."""
    by_key = Window.partitionBy("key").orderBy("seq")
    return records.select(
        "key",
        "seq",
        "op",
        F.row_number().over(by_key).cast("long").alias("version"),
        F.lag("value").over(by_key).alias("prev_value"),
    )


def overwrite(rows: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """Upsert a table onto itself: for each key the row that is last in ``order``."""
    return newest(rows, keys, F.struct(*order), carry)


def apply_batch(state: DataFrame, ops: DataFrame) -> DataFrame:
    """(key, value) after the ordered ops (seq, key, op, value) on a state (key, value)."""
    base = state.select(F.lit(-1).cast("long").alias("seq"), "key", F.lit(PUT).alias("op"), "value")
    return fold(base.unionByName(ops.select("seq", "key", "op", "value"))).select("key", "value")
