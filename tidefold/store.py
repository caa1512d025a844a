"""The store: a durable, ordered key-value table on a folder that Spark can reach.

Writes append Parquet batches to ``log/`` and publish them by a new manifest
version; nothing that isn't in the manifest is read. Reads fold the log and the
sorted segments of one manifest version lazily. ``flush`` turns the log into
segments, ``compact`` moves segments down levels.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import messages
from .events import Events
from .functions import keys as K
from .functions.values import check_value
from .operators import compact, fold, scan
from .operators.scan import QueryArgs
from .sources import log as L
from .sources import manifest as M
from .sources.files import Folder

VERSION = "0.1.0"
_CARRY = ["value", "data"]


class Store:
    """One ordered map from keys to text or bytes.

    ``key`` is the key mode; it is kept in the manifest and another mode is
    refused. ``cache`` persists the folded view. ``auto_flush`` is the size of
    the log in MB beyond which a write flushes it; False never does.
    ``segment_bytes`` is the size of a segment file and ``level_mb`` what level 0
    holds in MB, some files by default; each level below holds ten times as much. Raise both
    for large tables. One writer at a time: opening takes a lock file, ``force``
    breaks a stale one, and deletes what a crashed writer left unpublished.
    """

    version = VERSION

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str = "any",
        cache: bool = False,
        auto_flush: float | bool = 2,
        force: bool = False,
        segment_bytes: int | None = None,
        level_mb: float | None = None,
    ):
        K.key_type(key)
        self.segment_bytes = segment_bytes or compact.SEGMENT_BYTES
        self.level_mb = level_mb or compact.LEVEL_FILES * self.segment_bytes / 1_000_000
        self.spark, self.path, self.key_type, self.memory_cache, self.auto_flush = spark, path.rstrip("/"), key, cache, auto_flush
        self.events, self._folder = Events(), Folder(spark, path)
        self._open, self._compacting, self._tx = False, False, None
        self._tx_over, self._tx_thread = threading.Condition(), None
        self._count: tuple[int, int] | None = None
        self._cached: tuple[int, DataFrame] | None = None
        self._folder.make("log")
        self._folder.make("segments")
        self._lock = uuid.uuid4().hex
        if force:
            self._folder.delete("LOCK")
        if not self._folder.write_new("LOCK", self._lock):
            raise RuntimeError("the store is open elsewhere")
        try:
            found = M.load(self._folder)
            if found is not None and found.mode != key:
                raise ValueError(f"this store has {found.mode} keys, not {key}")
            if found is None:
                found = M.Manifest(key)
                M.store(self._folder, found)
        except BaseException:
            self._folder.delete("LOCK")
            raise
        self.manifest, self._open = found, True
        self._vacuum()
        #: Bytes of each batch of the log.
        self._log_bytes = {n: self._folder.size(f"log/{n}") for n in found.log}
        self.events.trigger("ready")

    # Lifecycle

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def on(self, event: str, callback: Callable) -> None:
        self.events.on(event, callback)

    def off(self, event: str, callback: Callable) -> None:
        self.events.off(event, callback)

    @property
    def is_tx(self) -> bool:
        return self._tx is not None

    @property
    def is_compacting(self) -> bool:
        return self._compacting

    def is_open(self) -> bool:
        return self._open

    def is_closed(self) -> bool:
        return not self._open

    def ready(self) -> Store:
        return self

    def close(self) -> None:
        """Close; a second call does nothing. An open transaction is left incomplete."""
        if not self._open:
            return
        self._open = False
        self._forget()
        if self._folder.has("LOCK") and self._folder.read("LOCK") == self._lock:
            self._folder.delete("LOCK")
        self.events.trigger("close")

    def _forget(self) -> None:
        if self._cached:
            self._cached[1].unpersist()
        self._cached = self._count = None

    def _check(self) -> None:
        if not self._open:
            raise RuntimeError("the store is closed")

    # The folded view

    def _log_paths(self, manifest: M.Manifest) -> list[str]:
        return [f"{self.path}/log/{n}" for n in manifest.log]

    def log(self) -> DataFrame:
        """All records of the log, with those of incomplete transactions."""
        self._check()
        return L.read_log(self.spark, self._log_paths(self.manifest), self.key_type)

    def records(self, segments: list[M.Segment] | None = None) -> DataFrame:
        """Committed records of the log, and those of the segments."""
        self._check()
        own = self.manifest.segments if segments is None else segments
        runs = L.read_segments(self.spark, [f"{self.path}/{s.file}" for s in own], self.key_type)
        done = self._committed().select(*runs.columns)
        return done.unionByName(runs) if own else done

    def _committed(self) -> DataFrame:
        log = self.log()
        return fold.committed_by(log, log.select("tx", "op"))

    def view(self, near: tuple | None = None) -> DataFrame:
        """(key, value, data): the newest committed state; value holds text, data bytes.

        ``near`` (lo, hi) are bounds that the caller filters by anyway: segments
        whose range lies outside aren't opened.
        """
        self._check()
        if self.memory_cache:
            if self._cached is None or self._cached[0] != self.manifest.version:
                self._forget()
                self._cached = (self.manifest.version, self._fold(self.records()).persist())
            return self._cached[1]
        segments = self.manifest.segments
        if near is not None:
            lo, hi = near
            segments = [
                s
                for s in segments
                if (lo is None or _order(s.hi) >= _order(_bound(lo, self.key_type)))
                and (hi is None or _order(s.lo) <= _order(_bound(hi, self.key_type)))
            ]
        return self._fold(self.records(segments))

    def _fold(self, records: DataFrame) -> DataFrame:
        return fold.fold(records, F.struct("seq", "ord"), _CARRY)

    def create_view(self, name: str) -> None:
        """Register the view under a name for SQL."""
        self.view().createOrReplaceTempView(name)

    def as_of(self, seq: int) -> DataFrame:
        """The state before a write, as far back as the log and unmerged segments go."""
        return self._fold(fold.as_of(self.records(), seq))

    # Point reads

    def get(self, key) -> str | bytes | None:
        k = self._plain(key)
        row = scan.get(self.view((k, k)), k, self.key_type).select(*_CARRY).first()
        self.events.trigger("get", key)
        return None if row is None else _value(row)

    def get_many(self, keys: DataFrame | list) -> DataFrame:
        """(key, value, data) for each wanted key, nulls where it is missing: one join."""
        return scan.get_many(self._keys(keys), self.view())

    def exists(self, key) -> bool:
        k = self._plain(key)
        found = scan.get(self.view((k, k)), k, self.key_type).select("key").first() is not None
        self.events.trigger("exists", key)
        return found

    def exists_many(self, keys: DataFrame | list) -> DataFrame:
        return scan.exists(self._keys(keys), self.view())

    def get_count(self) -> int:
        """Visible keys; kept for each manifest version."""
        if self._count is None or self._count[0] != self.manifest.version:
            self._count = (self.manifest.version, scan.count(self.view()).first()["n"])
        self.events.trigger("get-count")
        return self._count[1]

    def _plain(self, key):
        K.python_key(key, self.key_type)
        return key

    def _keys(self, keys: DataFrame | list) -> DataFrame:
        if isinstance(keys, DataFrame):
            c = keys.columns[0]
            return keys.select(K.normalize(F.col(c), self.key_type, keys.schema[c].dataType).alias("key"))
        return self.spark.createDataFrame(
            [(K.python_key(k, self.key_type),) for k in keys], T.StructType([T.StructField("key", K.key_type(self.key_type))])
        )

    # Scans: a DataFrame, an iterator of rows, or callbacks

    def scan(self, reverse: bool = False, keys: bool = True, values: bool = True) -> DataFrame:
        return scan.scan(self.view(), reverse, keys, values)

    def range_frame(self, lo, hi, reverse: bool = False) -> DataFrame:
        return scan.key_range(self.view((lo, hi)), lo, hi, self.key_type, reverse)

    def offset_frame(self, offset: int, limit: int | None = None, reverse: bool = False) -> DataFrame:
        return scan.page(self.view(), offset, limit, reverse)

    def query_frame(self, args: QueryArgs | dict | None = None, **more) -> DataFrame:
        args = QueryArgs.of(args, **more)
        lo, hi = (args.gt if args.gt is not None else args.gte), (args.lt if args.lt is not None else args.lte)
        return scan.query(self.view((lo, hi)), args, self.key_type)

    def _rows(self, event: str, frame: DataFrame) -> Iterator:
        """Keys, values or (key, value) pairs of an ordered frame, fetched partition by partition."""
        self.events.trigger(event)
        names = set(frame.columns)
        for row in frame.toLocalIterator(prefetchPartitions=True):
            if names == {"key"}:
                yield K.plain_key(row["key"], self.key_type)
            elif "key" not in names:
                yield _value(row) if "value" in names else {}
            else:
                yield K.plain_key(row["key"], self.key_type), _value(row)
        self.events.trigger(f"{event}-end")

    def _call(self, rows: Iterator, on_row: Callable, on_done: Callable | None) -> None:
        try:
            for x in rows:
                on_row(*(x if isinstance(x, tuple) else (x,)))
        except Exception as e:
            if on_done is None:
                raise
            on_done(e)
            return
        if on_done:
            on_done(None)

    def get_all_it(self, reverse: bool = False) -> Iterator:
        return self._rows("get-all", self.scan(reverse))

    get_all_stream = get_all_it

    def get_all(self, on_row: Callable, on_done: Callable | None = None, reverse: bool = False) -> None:
        self._call(self.get_all_it(reverse), on_row, on_done)

    def get_all_keys_it(self, reverse: bool = False) -> Iterator:
        return self._rows("get-keys", self.scan(reverse, values=False))

    get_all_keys_stream = get_all_keys_it

    def get_all_keys(self, on_row: Callable, on_done: Callable | None = None, reverse: bool = False) -> None:
        self._call(self.get_all_keys_it(reverse), on_row, on_done)

    def range_it(self, lo, hi, reverse: bool = False) -> Iterator:
        return self._rows("get-range", self.range_frame(lo, hi, reverse))

    range_stream = range_it

    def range(self, lo, hi, on_row: Callable, on_done: Callable | None = None, reverse: bool = False) -> None:
        self._call(self.range_it(lo, hi, reverse), on_row, on_done)

    def offset_it(self, offset: int, limit: int | None = None, reverse: bool = False) -> Iterator:
        return self._rows("get-offset", self.offset_frame(offset, limit, reverse))

    offset_stream = offset_it

    def offset(self, offset: int, limit: int | None, on_row: Callable, on_done: Callable | None = None, reverse: bool = False) -> None:
        self._call(self.offset_it(offset, limit, reverse), on_row, on_done)

    def query_it(self, args: QueryArgs | dict | None = None, **more) -> Iterator:
        return self._rows("get-query", self.query_frame(args, **more))

    query_stream = query_it

    def query(self, args: QueryArgs | dict | None, on_row: Callable, on_done: Callable | None = None) -> None:
        self._call(self.query_it(args), on_row, on_done)

    def create_read_stream(self, args: QueryArgs | dict | None = None) -> Iterator[dict]:
        """Dicts with key and value, or with those of the two that ``args`` asks for."""
        args = QueryArgs.of(args)
        for x in self._rows("read-stream", self.query_frame(args)):
            if args.keys and args.values:
                yield {"key": x[0], "value": x[1]}
            else:
                yield {"key": x} if args.keys else {"value": x} if args.values else {}

    def create_key_stream(self, args: QueryArgs | dict | None = None) -> Iterator:
        return self._rows("read-key-stream", self.query_frame(QueryArgs.of(args, keys=True, values=False)))

    def create_value_stream(self, args: QueryArgs | dict | None = None) -> Iterator:
        return self._rows("read-value-stream", self.query_frame(QueryArgs.of(args, keys=False, values=True)))

    # Writes

    def put(self, key, value) -> None:
        """Set one key. Inside a transaction the write stays unseen until its end."""
        self._append([("put", key, value)])
        self.events.trigger("put", key, value)

    def delete(self, key):
        """Delete one key, there or not; returns it."""
        self._append([("del", key, None)])
        self.events.trigger("delete", key)
        return key

    del_ = delete

    def _op_rows(self, ops: list[tuple]) -> list[tuple]:
        out = []
        for n, (op, key, value) in enumerate(ops):
            if key is None:
                raise ValueError(messages.NULL_KEY)
            text, data, _ = check_value(value) if op == fold.PUT else (None, None, 0)
            out.append((n, op, K.python_key(key, self.key_type), text, data))
        return out

    def _append(self, ops: list[tuple], tx: int | None = None) -> None:
        rows = self._op_rows(ops)
        self._check()
        schema = T.StructType([f for f in L.log_schema(self.key_type) if f.name in ("ord", "op", "key", "value", "data")])
        frame = self.spark.createDataFrame(rows, schema).coalesce(1)
        self._publish(frame, self._tx if tx is None else tx)

    def put_many(self, rows: DataFrame) -> None:
        """Write a DataFrame (key, value and, if wanted, op and ord) as one atomic batch.

        ``value`` is text or binary. Of rows with one key that of the greatest
        ``ord`` wins; without an ``ord`` column keys should be distinct. The
        write is distributed; null keys and, on puts, null values are refused.
        """
        self._check()
        kind = rows.schema["value"].dataType
        if not isinstance(kind, T.StringType | T.BinaryType):
            raise ValueError(messages.BAD_VALUE)
        text = isinstance(kind, T.StringType)
        key = K.normalize(F.col("key"), self.key_type, rows.schema["key"].dataType)
        op = F.col("op") if "op" in rows.columns else F.lit(fold.PUT)
        refuse = lambda bad, say, good: F.when(bad, F.raise_error(F.lit(say))).otherwise(good)
        frame = rows.select(
            (F.col("ord").cast("long") if "ord" in rows.columns else F.monotonically_increasing_id()).alias("ord"),
            op.alias("op"),
            refuse(F.col("key").isNull(), messages.NULL_KEY, key).alias("key"),
            refuse((op == fold.PUT) & F.col("value").isNull(), messages.BAD_VALUE, F.col("value") if text else F.lit(None).cast("string")).alias("value"),
            (F.lit(None).cast("binary") if text else F.col("value")).alias("data"),
        )
        self._publish(frame, self._tx)

    def _publish(self, frame: DataFrame, tx: int | None, then: str | None = None) -> None:
        """Write one batch and make it part of the table, both or neither."""
        m = self.manifest
        full = frame.select(F.lit(m.next_seq).cast("long").alias("seq"), F.lit(tx).cast("long").alias("tx"), *frame.columns)
        batch = f"{m.next_seq:016d}-{uuid.uuid4().hex[:8]}"
        L.with_crc(full, self.key_type).write.parquet(f"{self.path}/log/{batch}")
        self._log_bytes[batch] = self._folder.size(f"log/{batch}")
        self._commit(m.changed(next_seq=m.next_seq + 1, log=[*m.log, batch]))
        if tx is None:
            self._maybe_flush()

    def _commit(self, manifest: M.Manifest) -> None:
        M.store(self._folder, manifest)
        self.manifest = manifest

    # Transactions and batches

    def start_tx(self) -> int:
        self._check()
        if self._tx is not None:
            raise RuntimeError(messages.NESTED_TX)
        self._tx, self._tx_thread = self.manifest.next_tx, threading.get_ident()
        self._commit(self.manifest.changed(next_tx=self._tx + 1))
        self.events.trigger("tx-start", self._tx)
        return self._tx

    begin_transaction = start_tx

    def _outcome(self, op: str, event: str) -> int | None:
        self._check()
        tx = self._tx
        if tx is None:
            return None
        marker = self.spark.createDataFrame(
            [(0, op, None, None, None)],
            T.StructType([f for f in L.log_schema(self.key_type) if f.name in ("ord", "op", "key", "value", "data")]),
        ).coalesce(1)
        self._publish(marker, tx)
        with self._tx_over:
            self._tx = self._tx_thread = None
            self._tx_over.notify_all()
        self.events.trigger(event, tx)
        self._maybe_flush()
        return tx

    def end_tx(self) -> int | None:
        return self._outcome(fold.COMMIT, "tx-end")

    end_transaction = end_tx

    def abort_tx(self) -> int | None:
        """Drop the open transaction; without one nothing happens."""
        return self._outcome(fold.ABORT, "tx-abort")

    def batch(self, ops: list[dict] | None = None, wait: float | None = None) -> Batch | None:
        """Apply ``ops`` ({type: put or del, key, value}) in order, all or none.

        Unknown types are passed over and a missing value is empty text. Without
        ``ops``, a chain to add them to. Another thread's transaction is waited
        for, ``wait`` seconds at most.
        """
        if ops is None:
            return Batch(self)
        with self._tx_over:
            if self._tx is not None and self._tx_thread == threading.get_ident():
                raise RuntimeError(messages.NESTED_TX)
            if not self._tx_over.wait_for(lambda: self._tx is None, wait):
                raise TimeoutError("a transaction is still open")
            own = [(o["type"], o.get("key"), o.get("value", "")) for o in ops if o.get("type") in (fold.PUT, fold.DELETE)]
            if own:
                self._append(own)
        return None

    # Maintenance

    def level_bytes(self) -> dict[int, int]:
        """Bytes of the segments of each level."""
        out: dict[int, int] = {}
        for s in self.manifest.segments:
            out[s.level] = out.get(s.level, 0) + s.bytes
        return out

    def _maybe_flush(self) -> None:
        if self.auto_flush is False or self._tx is not None or self._compacting:
            return
        limit = (2 if self.auto_flush is True else self.auto_flush) * 1_000_000
        if sum(self._log_bytes.get(n, 0) for n in self.manifest.log) > limit:
            self.flush_log()

    def flush_log(self) -> None:
        """Turn the log into level-0 segments, then compact."""
        self._check()
        if self._compacting:
            raise RuntimeError(messages.COMPACTING)
        if self._tx is not None:
            raise RuntimeError("a transaction is open")
        self._compacting = True
        self.events.trigger("compact-start")
        try:
            if self.manifest.log:
                folded = fold.fold(
                    self._committed(), F.struct("seq", "ord"), ["seq", "ord", *_CARRY], tombstones=True
                )
                old = self.manifest.log
                new = self._write_run(folded, 0, sum(self._log_bytes.values()))
                self._commit(self.manifest.changed(log=[], segments=[*self.manifest.segments, *new], next_segment=self._next))
                for n in old:
                    self._folder.delete(f"log/{n}")
                self._log_bytes = {}
            while self._compact_once():
                pass
        finally:
            self._compacting = False
        self._forget()
        self.events.trigger("compact-end")

    def compact(self, force: bool = False) -> None:
        """``flush_log``; with ``force``, then merge all segments into one sorted run without tombstones."""
        self.flush_log()
        if force and self.manifest.segments:
            deepest = max(s.level for s in self.manifest.segments)
            self._merge(self.manifest.segments, max(1, deepest))
            self._forget()

    def _write_run(self, rows: DataFrame, level: int, size: int) -> list[M.Segment]:
        """Write folded records as key-sorted files and describe them; ``size`` is that of their sources."""
        n = max(1, -(-size // self.segment_bytes))
        folder = f"segments/L{level}-{uuid.uuid4().hex}"
        cut = rows.select(*L.segment_schema(self.key_type).names).repartitionByRange(int(n), "key").sortWithinPartitions("key")
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in L.key_leaves(self.key_type)}
        cut.write.options(**blooms).parquet(f"{self.path}/{folder}")
        names = sorted(x for x in self._folder.names(folder) if x.endswith(".parquet"))
        done = L.read_segments(self.spark, [f"{self.path}/{folder}"], self.key_type)
        stats = {
            r["file"].rpartition("/")[2]: r
            for r in done.groupBy(F.input_file_name().alias("file"))
            .agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("rows"))
            .collect()
        }
        out, self._next = [], self.manifest.next_segment
        for x in names:
            if r := stats.get(x):
                lo, hi = (_stored(r[k], self.key_type) for k in ("lo", "hi"))
                out.append(M.Segment(self._next, level, f"{folder}/{x}", lo, hi, r["rows"], self._folder.size(f"{folder}/{x}")))
                self._next += 1
        return out

    def _compact_once(self) -> bool:
        """Move what is too much in the first level above its limit down, in one job; False if none is."""
        for level in range(max((s.level for s in self.manifest.segments), default=-1) + 1):
            own = self.manifest.at_level(level)
            over = sum(s.bytes for s in own) - compact.level_limit(level, self.level_mb)
            if over <= 0:
                continue
            if level == 0:
                # Level 0 runs overlap: the oldest go.
                turn = sorted(own, key=lambda s: s.id)
            else:
                # The keys after those that went last, so that none wait for ever.
                last = self.manifest.cursors.get(str(level))
                ordered = sorted(own, key=lambda s: _order(s.lo))
                after = [s for s in ordered if isinstance(last, list) and _order(s.lo) > _order(last)]
                turn = after or ordered
            picks, moved = [], 0
            for s in turn:
                if moved >= over:
                    break
                picks.append(s)
                moved += s.bytes
            lo, hi = min((s.lo for s in picks), key=_order), max((s.hi for s in picks), key=_order)
            below = [s for s in self.manifest.at_level(level + 1) if _order(s.lo) <= _order(hi) and _order(lo) <= _order(s.hi)]
            self._merge([*picks, *below], level + 1, {**self.manifest.cursors, str(level): picks[-1].hi})
            return True
        return False

    def _merge(self, inputs: list[M.Segment], level: int, cursors: dict | None = None) -> None:
        gone = {s.id for s in inputs}
        rows = L.read_segments(self.spark, [f"{self.path}/{s.file}" for s in inputs], self.key_type)
        state = fold.fold(rows, F.struct("seq", "ord"), ["seq", "ord", *_CARRY], tombstones=True)
        # A tombstone stays while any other segment below may hold an older record of its key.
        deeper = [s for s in self.manifest.segments if s.id not in gone and s.level >= level and any(_overlap(s, i) for i in inputs)]
        older = L.read_segments(self.spark, [f"{self.path}/{s.file}" for s in deeper], self.key_type) if deeper else None
        new = self._write_run(compact.purge(state, older), level, sum(s.bytes for s in inputs))
        kept = [s for s in self.manifest.segments if s.id not in gone]
        self._commit(self.manifest.changed(segments=[*kept, *new], next_segment=self._next, cursors=cursors or self.manifest.cursors))
        self._vacuum()

    def _vacuum(self) -> None:
        """Delete log batches and segment folders that the manifest doesn't name."""
        used = {s.file.split("/")[1] for s in self.manifest.segments}
        for folder, named in (("segments", used), ("log", set(self.manifest.log))):
            for n in self._folder.names(folder):
                if n not in named:
                    self._folder.delete(f"{folder}/{n}")

    def empty(self) -> None:
        """Drop all data: a manifest without files first, then the files."""
        self._check()
        if self._tx is not None:
            self.abort_tx()
        self._commit(self.manifest.changed(log=[], segments=[], cursors={}))
        self._forget()
        self._vacuum()
        self._log_bytes = {}
        self.events.trigger("clear")


class Batch:
    """A chain of writes that ``write`` applies at once."""

    def __init__(self, store: Store):
        self._store, self._ops = store, []

    def __len__(self) -> int:
        return len(self._ops)

    @property
    def length(self) -> int:
        return len(self._ops)

    def put(self, key, value) -> Batch:
        self._ops.append({"type": fold.PUT, "key": key, "value": value})
        return self

    def delete(self, key) -> Batch:
        self._ops.append({"type": fold.DELETE, "key": key})
        return self

    del_ = delete

    def clear(self) -> Batch:
        self._ops.clear()
        return self

    def write(self) -> None:
        self._store.batch(self._ops)


def _value(row) -> str | bytes | None:
    if row["data"] is not None:
        return bytes(row["data"])
    return row["value"]


def _stored(key, mode: str) -> list:
    """A collected key as JSON: [kind, number or text or hex]."""
    if mode == "any":
        kind = key["kind"]
        return [kind, key["num"] if kind == K.NUMBER else key["str"] if kind == K.STRING else bytes(key["bin"]).hex()]
    return [K.BYTES, bytes(key).hex()] if mode == "buffer" else [K.STRING if mode == "string" else K.NUMBER, key]


def _bound(key, mode: str) -> list:
    k = K.python_key(key, mode)
    if mode == "any":
        return [k[0], k[1 + k[0]].hex() if k[0] == K.BYTES else k[1 + k[0]]]
    return _stored(k, mode)


def _order(stored: list) -> tuple:
    """Sort key of a stored key: text as UTF-8 bytes, as Spark orders it; hex sorts as its bytes."""
    kind, v = stored
    return (kind, v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v)


def _overlap(a: M.Segment, b: M.Segment) -> bool:
    return _order(a.lo) <= _order(b.hi) and _order(b.lo) <= _order(a.hi)


def _aliases() -> None:
    """The camel-case names of the methods, and ``del``."""
    for name in [n for n in vars(Store) if "_" in n and not n.startswith("_") and not n.endswith("_")]:
        head, *rest = name.split("_")
        setattr(Store, head + "".join(x.capitalize() for x in rest), getattr(Store, name))
    for name, attribute in (("keyType", "key_type"), ("memoryCache", "memory_cache")):
        setattr(Store, name, property(lambda self, a=attribute: getattr(self, a)))
    setattr(Store, "del", Store.delete)
    setattr(Batch, "del", Batch.delete)


_aliases()
