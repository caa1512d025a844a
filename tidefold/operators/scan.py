"""Reading a folded view (key, value columns): lookups, ranges, order, limits.

Every function returns a lazy DataFrame made of plain filters, projections and
orders; key bounds reach the files and a limit becomes a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import bound, within


@dataclass
class QueryArgs:
    """What to read. Bounds are on the key; ``limit`` 0 or None is no limit.

    ``bounds="swapped"`` gives the far bound of a scan the other sense: the
    exclusive one includes its key and the inclusive one doesn't.
    """

    gt: Any = None
    gte: Any = None
    lt: Any = None
    lte: Any = None
    reverse: bool = False
    limit: int | None = None
    offset: int | None = None
    keys: bool = True
    values: bool = True
    bounds: str = "conventional"

    @classmethod
    def of(cls, args: QueryArgs | dict | None = None, **more) -> QueryArgs:
        if isinstance(args, QueryArgs):
            args = {f.name: getattr(args, f.name) for f in fields(cls)}
        out = cls(**((args or {}) | more))
        out.check()
        return out

    def check(self) -> None:
        if self.gt is not None and self.gte is not None or self.lt is not None and self.lte is not None:
            raise ValueError("give either the exclusive or the inclusive bound of a side")
        has_bound = any(x is not None for x in (self.gt, self.gte, self.lt, self.lte))
        if self.offset is not None and has_bound:
            raise ValueError("offset can't be combined with key bounds")
        for name in ("limit", "offset"):
            v = getattr(self, name)
            if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 0):
                raise ValueError(f"{name} must be a whole number of 0 or more")
        if self.bounds not in ("conventional", "swapped"):
            raise ValueError("bounds is conventional or swapped")


def _key_order(reverse: bool) -> Column:
    return F.col("key").desc() if reverse else F.col("key").asc()


def between(view: DataFrame, lo, hi, mode: str) -> DataFrame:
    """Keys from lo to hi, both included; unordered."""
    return view.where(within(F.col("key"), lo, hi, mode))


def bounded(view: DataFrame, args: QueryArgs, mode: str) -> DataFrame:
    """The rows within the bounds of ``args``; unordered."""
    gt, gte, lt, lte = args.gt, args.gte, args.lt, args.lte
    if args.bounds == "swapped":
        if args.reverse:
            gt, gte = gte, gt
        else:
            lt, lte = lte, lt
    for key, test in ((gt, "gt"), (gte, "ge"), (lt, "lt"), (lte, "le")):
        if key is not None:
            view = view.where(bound(F.col("key"), test, key, mode))
    return view


def shape(view: DataFrame, args: QueryArgs) -> DataFrame:
    """Keys only, values only, both, or a marker a row where neither is asked for."""
    values = [c for c in view.columns if c != "key"]
    if args.keys and args.values:
        return view
    if args.keys:
        return view.select("key")
    return view.select(*values) if args.values else view.select(F.lit(True).alias("row"))


def query(view: DataFrame, args: QueryArgs | dict | None = None, mode: str = "any", **more) -> DataFrame:
    """An ordered read with any of bounds, direction, offset, limit and projection."""
    args = QueryArgs.of(args, **more)
    out = bounded(view, args, mode)
    if args.keys and not args.values:
        out = out.select("key")
    out = out.orderBy(_key_order(args.reverse))
    if args.offset:
        out = out.offset(args.offset)
    if args.limit:
        out = out.limit(args.limit)
    return shape(out, args)


def scan(view: DataFrame, reverse: bool = False, keys: bool = True, values: bool = True) -> DataFrame:
    return query(view, reverse=reverse, keys=keys, values=values)


def key_range(view: DataFrame, lo, hi, mode: str, reverse: bool = False) -> DataFrame:
    """Ordered rows from lo to hi, both included in either direction."""
    return between(view, lo, hi, mode).orderBy(_key_order(reverse))


def page(view: DataFrame, offset: int, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Skip ``offset`` keys from the start (or end) and give at most ``limit``."""
    return query(view, offset=offset, limit=limit, reverse=reverse)


def get(view: DataFrame, key, mode: str) -> DataFrame:
    return view.where(bound(F.col("key"), "eq", key, mode))


def get_many(keys: DataFrame, view: DataFrame) -> DataFrame:
    """A row for each wanted key; nulls where the view has none."""
    return keys.join(view, "key", "left")


def exists(keys: DataFrame, view: DataFrame) -> DataFrame:
    """(key, present) for each wanted key."""
    found = view.select("key", F.lit(True).alias("_found"))
    return keys.join(found, "key", "left").select("key", F.coalesce("_found", F.lit(False)).alias("present"))


def count(view: DataFrame) -> DataFrame:
    return view.select("key").agg(F.count("*").alias("n"))


def with_position(ordered: DataFrame, reverse: bool = False) -> DataFrame:
    """Add ``pos``, the 1-based place in key order."""
    return ranked(ordered, reverse, 1, "pos")


def rank(view: DataFrame) -> DataFrame:
    """Add ``rnk``, the 0-based place in key order."""
    return ranked(view, False, 0, "rnk")


#: Keys looked at for the cuts of the key space: one in so many, chosen by hash.
LOOK_AT = 64


def key_cuts(rows: DataFrame) -> DataFrame:
    """One row with ``cuts``, sorted keys that part the ``key`` space of ``rows``: less than
    ``spark.sql.shuffle.partitions`` of them.

    They are keys chosen by hash, one a hash group, so a key that many rows repeat
    counts once and the cuts are about even in keys.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, 1)
    key, code = F.col("key"), F.xxhash64("key")
    seen = rows.select("key").where(key.isNotNull() & (F.pmod(code, F.lit(LOOK_AT)) == 0))
    some = seen.groupBy(F.pmod(F.xxhash64(code), F.lit(n)).alias("_group")).agg(F.min_by("key", code).alias("key"))
    return some.agg(F.sort_array(F.collect_list("key")).alias("cuts"))


def stretch_of(rows: DataFrame, cuts: DataFrame, **named: str) -> DataFrame:
    """For each name=column add the number of the key stretch that the column's key lies in, rising with the key.

    The cuts are a scalar subquery, so nothing runs before the plan does. What is
    computed with stretches doesn't depend on where they are cut. Null keys are in stretch 0.
    """
    bits = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()
    # Binary search: the number of cuts not after the key, the greatest power of two first.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])

    def place(key: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) <= key, at + step).otherwise(at))

    out = rows.withColumn("_cuts", cuts.scalar())
    return out.withColumns({name: place(F.col(c)) for name, c in named.items()}).drop("_cuts")


def running(rows: DataFrame, amount: Column, name: str, reverse: bool = False) -> DataFrame:
    """Add the sum of ``amount`` over all rows before this one in key order.

    Sums run within stretches of the key space; of the stretches only the totals
    meet in one task, no more than there are shuffle partitions.
    """
    columns = rows.columns
    order = _key_order(reverse)
    cut = stretch_of(rows, key_cuts(rows), _part="key").withColumn("_amount", amount)
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part_order = F.col("_part").desc() if reverse else F.col("_part").asc()
    ahead = Window.orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy("_part")
        .agg(F.sum("_amount").alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    )
    before = F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    return (
        cut.withColumn("_before", before)
        .join(F.broadcast(starts), "_part")
        .select((F.col("_start") + F.col("_before")).cast("long").alias(name), *columns)
    )


def ranked(view: DataFrame, reverse: bool, first: int, name: str) -> DataFrame:
    placed = running(view, F.lit(1), "_place", reverse)
    return placed.select((F.col("_place") + first).alias(name), *view.columns)
