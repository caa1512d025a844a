"""Substring dedup by recompression.

Words are recompressed in generations: every maximal run of one symbol becomes a
block (at the start of each round), and neighbours are paired where the left
one's name falls in the left half of the alphabet and the right one's in the
right half. A symbol's name is a 128-bit mix of the names of its parts, down to
128-bit hashes of words, and halves are drawn from names; so a name stands for the same
words in every document, on every executor and in every round, and needs no dictionary to be
joined back. Symbols grow by a third a generation, without a bound.

Equal substrings so have equal symbols but for their ends. What a window of
words shares with all its copies is found by popping: before each generation
the symbols at both ends that may be merged with one outside are dropped, and
the rest, its core, is parsed alike everywhere. The longest symbol of the last core that isn't
empty (the leftmost of equals) stands for the window.

Rounds are Spark jobs of GENERATIONS generations each:

1. Over all documents: symbols that stand for windows are grouped by name. Only
   windows whose symbol more than one document has are gone on with.
2. Over the words of those windows, again and again: symbols are recompressed
   further and grouped by name, and those that more than one document has go
   into the next round, until no two of them are left side by side. A symbol of
   a window's words or more that a smaller doc_id has too settles all windows inside it.
3. Windows that no such symbol settles, among them all of a repeat's first
   document, are compared word for word, as 128-bit names of their 50 words.

Groups are minima, combined before the shuffle, and rows meet group results in
joins without an aggregate below them, so a common name is split.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_folder, free_shuffles, map_batches, mix, split_words

#: Fixed value of the registered query.
WINDOW = 50
#: Generations of runs and pairs in a round.
GENERATIONS = 6
#: Text that a Python worker parses at a time.
TEXT_BYTES = 1_000_000
_RUN, _PAIR, _OTHER = np.uint64(0x72756E), np.uint64(0x70616972), np.uint64(0x9E37)


class Words:
    """Word (bytes) -> 128-bit hash, as two arrays; forgets everything once it holds ``limit`` words."""

    def __init__(self, limit: int = 120_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.ids, self.names = {}, np.empty((1024, 2), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """(len(words), 2) halves of the hashes."""
        if len(self.ids) > self.limit:
            self._clear()
        ids = self.ids
        new = [w for w in set(words) if w not in ids]
        if new:
            while len(self.names) < len(ids) + len(new):
                self.names = np.concatenate([self.names, np.empty_like(self.names)])
            raw = b"".join(xxhash.xxh3_128_digest(w) for w in new)
            self.names[len(ids) : len(ids) + len(new)] = np.frombuffer(raw, ">u8").reshape(-1, 2)
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
        return self.names[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]


class Symbols:
    """Symbols in order: 128-bit names (a, b), words that each stands for, and the sequence it is in.

    ``runs`` and ``pairs`` make them the next generation and return old index -> new index.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, words: np.ndarray, seq: np.ndarray):
        self.a, self.b, self.words, self.seq = a, b, words, seq

    def __len__(self) -> int:
        return len(self.a)

    def side(self, generation: int) -> np.ndarray:
        """Half of the alphabet of each symbol; True is the right one."""
        return (mix(self.a, np.uint64(0x5EED + generation)) >> np.uint64(63)).astype(bool)

    def runs(self) -> np.ndarray:
        n = len(self)
        if not n:
            return np.empty(0, np.int64)
        head = np.append(True, (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1]) | (self.seq[1:] != self.seq[:-1]))
        to, at = np.cumsum(head) - 1, np.flatnonzero(head)
        count = np.diff(np.append(at, n))
        self.words = np.add.reduceat(self.words, at)
        self.a, self.b, self.seq = self.a[at], self.b[at], self.seq[at]
        long = np.flatnonzero(count > 1)
        times = count[long].astype(np.uint64)
        self.a[long] = mix(self.a[long] ^ _RUN, times)
        self.b[long] = mix(self.b[long] ^ _OTHER, times)
        return to

    def pairs(self, generation: int) -> np.ndarray:
        n, side = len(self), self.side(generation)
        left = np.flatnonzero(~side[:-1] & side[1:] & (self.seq[:-1] == self.seq[1:]))
        keep = np.ones(n, bool)
        keep[left + 1] = False
        a, b, words = self.a.copy(), self.b.copy(), self.words.copy()
        a[left] = mix(a[left] ^ _PAIR, a[left + 1])
        b[left] = mix(b[left] ^ _OTHER, b[left + 1] + _PAIR)
        words[left] += words[left + 1]
        self.a, self.b, self.words, self.seq = a[keep], b[keep], words[keep], self.seq[keep]
        return np.cumsum(keep) - 1

    def grow(self, round_: int) -> None:
        """The generations of one round."""
        self.runs()
        for g in range(GENERATIONS):
            self.pairs(round_ * GENERATIONS + g)


def _longest(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the longest symbol, the leftmost of equals, in each [lo, hi)."""
    out, width = np.empty(len(lo), np.int64), hi - lo
    power = np.frexp(width.astype(np.float64))[1] - 1
    level = words.astype(np.int64) << 32 | (0xFFFFFFFF - np.arange(len(words)))
    for p in range(int(power.max(initial=-1)) + 1):
        at = np.flatnonzero(power == p)
        out[at] = 0xFFFFFFFF - (np.maximum(level[lo[at]], level[hi[at] - (1 << p)]) & 0xFFFFFFFF)
        if 2 << p > len(level) + (1 << p):
            break
        level = np.maximum(level[: len(level) - (1 << p)], level[1 << p :])
    return out


class Parsed:
    """The words of a batch of texts; after ``first_round`` also their symbols and stretches of windows.

    A stretch is a row of windows that one name stands for.
    """

    def __init__(self, texts: list[str | None], words: Words, window: int = WINDOW):
        split = [split_words(t) for t in texts]
        size = np.array([len(w) for w in split], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.names = np.concatenate([words.of(w) for w in split]) if split else np.empty((0, 2), np.uint64)
        self.doc = np.repeat(np.arange(len(split)), size)
        self.window = window

    def first_round(self) -> None:
        n = len(self.names)
        s = Symbols(self.names[:, 0].copy(), self.names[:, 1].copy(), np.ones(n, np.int64), self.doc)
        at = np.flatnonzero(np.repeat(self.ends, self.ends - self.starts) - np.arange(n) >= self.window)
        lo, hi = at.copy(), at + self.window  # core of each window in symbols
        live, own = np.arange(len(at)), np.empty(len(at), np.uint64)

        def settle(which):
            own[live[which]] = s.a[_longest(s.words, lo[which], hi[which])]

        for step in range(GENERATIONS + 1):
            if step == 0:  # the runs that a window begins and ends with may go on outside
                head = np.append(True, (s.a[1:] != s.a[:-1]) | (s.seq[1:] != s.seq[:-1]))[:n]
                run = np.cumsum(head) - 1
                first = np.append(np.flatnonzero(head), n)
                low, high = first[run[lo] + 1], first[run[hi - 1]]
            else:
                side = s.side(step - 1)
                low, high = lo + side[lo], hi - ~side[hi - 1]
            left = low < high
            if not left.all():
                settle(~left)
            lo, hi, live = low[left], high[left], live[left]
            to = s.runs() if step == 0 else s.pairs(step - 1)
            lo, hi = to[lo], to[hi - 1] + 1
        settle(slice(None))
        self.symbols = s
        new = np.append(True, (own[1:] != own[:-1]) | (np.diff(at) != 1))[: len(at)]
        first = np.flatnonzero(new)
        self.anchor, self.lo = own[first], at[first]
        self.hi = at[np.append(first[1:], len(at)) - 1] if len(first) else at

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the windows that start at the given words."""
        return tuple(self._window(self.names[:, k], at, k) for k in (0, 1))

    def _window(self, level: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
        out, done, size, left = mix(np.full(len(at), seed, np.uint64), np.uint64(1)), 0, 1, self.window
        while left:
            if left & 1:
                out = mix(out, level[at + done])
                done += size
            left >>= 1
            if left:
                level = mix(level[: len(level) - size], level[size:]) if len(level) > size else level[:0]
                size *= 2
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """A list for each row of the values that belong to it; ``row`` ascends."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_WORDS = Words()


def _words() -> Words:
    """The Python worker's word hashes."""
    return _WORDS


_KEY = ["doc_id", "tie"]


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The first round of every row (doc_id, tie, text): its symbols (a, b, words) and stretches (anchor, lo, hi)."""

    def run(cols):
        p = Parsed(cols["text"].to_pylist(), _words(), window)
        p.first_round()
        s, rows = p.symbols, len(p.ends)
        d = p.doc[p.lo]
        symbol = lambda v: _lists(v, s.seq, rows)
        stretch = lambda v: _lists(v, d, rows)
        return {
            "doc_id": cols["doc_id"],
            "tie": cols["tie"],
            "a": symbol(s.a.view(np.int64)),
            "b": symbol(s.b.view(np.int64)),
            "words": symbol(s.words.astype(np.int32)),
            "anchor": stretch(p.anchor.view(np.int64)),
            "lo": stretch((p.lo - p.starts[d]).astype(np.int32)),
            "hi": stretch((p.hi - p.starts[d]).astype(np.int32)),
        }

    longs, ints = "array<long>", "array<int>"
    return map_batches(
        docs.select(*_KEY, "text"), run, f"doc_id long, tie long, a {longs}, b {longs}, words {ints}, anchor {longs}, lo {ints}, hi {ints}", TEXT_BYTES
    )


def _shared(rows: DataFrame, *names: str) -> DataFrame:
    """Names that more than one document has, with the least of them."""
    ids = rows.groupBy(*names).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return cut_lineage(ids.where("least < most").drop("most"))


def shared_stretches(parsed: DataFrame) -> DataFrame:
    """doc_id, tie, live: stretches (lo, hi) of windows whose name more than one document has."""
    rows = parsed.select(*_KEY, F.explode(F.arrays_zip("anchor", "lo", "hi")).alias("x")).select(*_KEY, "x.*")
    names = _shared(rows, "anchor")
    free_shuffles(parsed.sparkSession)
    some = rows.join(names.select("anchor").hint("merge"), "anchor", "left_semi")
    return cut_lineage(some.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("live")))


def _live_symbols(parsed: DataFrame, live: DataFrame, window: int) -> DataFrame:
    """doc_id, tie, syms (first word, words, a, b): the symbols inside the words of live windows."""
    own = parsed.select(*_KEY, "a", "b", "words").join(live.hint("merge"), _KEY)

    def run(cols):
        offsets = np.asarray(cols["words"].offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        values = {k: np.asarray(cols[k].flatten()) for k in ("a", "b", "words")}
        keep, first = np.zeros(len(values["words"]), bool), np.zeros(len(values["words"]), np.int64)
        for k, spans in enumerate(cols["live"].to_pylist()):
            s = slice(offsets[k], offsets[k + 1])
            end = np.cumsum(values["words"][s].astype(np.int64))
            first[s] = end - values["words"][s]
            away = np.zeros(int(end[-1]) + 1 if len(end) else 1, np.int64)
            for x in spans:
                away[x["lo"]] += 1
                away[min(x["hi"] + window, len(away) - 1)] -= 1
            inside = np.concatenate([[0], np.cumsum(np.cumsum(away[:-1]) > 0)])
            keep[s] = inside[end] - inside[first[s]] == values["words"][s]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
        n = len(offsets) - 1
        return {"doc_id": cols["doc_id"], "tie": cols["tie"], "first": _lists(first[keep].astype(np.int32), row, n)} | {
            k: _lists(values[k][keep], row, n) for k in ("words", "a", "b")
        }

    return map_batches(own, run, "doc_id long, tie long, first array<int>, words array<int>, a array<long>, b array<long>")


def _grown(state: DataFrame, round_: int) -> DataFrame:
    """The state after the generations of a round."""

    def run(cols):
        offsets = np.asarray(cols["first"].offsets).astype(np.int64)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        first, words = (np.asarray(cols[k].flatten()).astype(np.int64) for k in ("first", "words"))
        a, b = (np.array(cols[k].flatten()).view(np.uint64) for k in ("a", "b"))
        # Only neighbours in the text are merged.
        gap = np.append(True, (rows[1:] != rows[:-1]) | (first[1:] != first[:-1] + words[:-1]))[: len(rows)]
        seq = np.cumsum(gap) - 1
        row_of, base = rows[gap], first[gap]
        s = Symbols(a, b, words, seq)
        s.grow(round_)
        upto = np.cumsum(s.words) - s.words
        head = np.append(True, s.seq[1:] != s.seq[:-1])[: len(s)]
        begin = base[s.seq] + upto - upto[head][s.seq] if len(s) else upto
        row, n = row_of[s.seq], len(offsets) - 1
        return {
            "doc_id": cols["doc_id"],
            "tie": cols["tie"],
            "first": _lists(begin.astype(np.int32), row, n),
            "words": _lists(s.words.astype(np.int32), row, n),
            "a": _lists(s.a.view(np.int64), row, n),
            "b": _lists(s.b.view(np.int64), row, n),
        }

    return map_batches(state, run, state.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))


def _side_by_side(syms: Column) -> Column:
    """Whether any two of the symbols are neighbours in the text."""
    pairs = F.zip_with(F.slice(syms, F.lit(1), F.size(syms) - 1), F.slice(syms, F.lit(2), F.size(syms) - 1), lambda x, y: x["first"] + x["words"] == y["first"])
    return F.when(F.size(syms) > 1, F.exists(pairs, lambda x: x)).otherwise(F.lit(False))


def rounds(state: DataFrame):
    """Yields for each further round doc_id, tie, first, words, a, b, least of the symbols that more than one document has."""
    round_ = 1
    state = cut_lineage(state)
    while not state.isEmpty():
        grown = cut_lineage(_grown(state, round_))
        drop_folder(state)
        rows = grown.select(*_KEY, F.explode(F.arrays_zip("first", "words", "a", "b")).alias("x")).select(*_KEY, "x.*")
        names = _shared(rows, "a", "b")
        shared = cut_lineage(rows.join(names.hint("merge"), ["a", "b"]))
        drop_folder(grown)
        drop_folder(names)
        yield shared
        each = shared.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("first", "words", "a", "b"))).alias("syms"))
        state = cut_lineage(each.where(_side_by_side(F.col("syms"))).select(*_KEY, *[F.col(f"syms.{k}").alias(k) for k in ("first", "words", "a", "b")]))
        free_shuffles(state.sparkSession)
        round_ += 1
    drop_folder(state)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tie, cuts: stretches (lo, hi) of window starts that repeat a smaller doc_id's.

    ``docs`` has doc_id, not null, tie, which tells rows of one doc_id apart, and text.
    """
    spark = docs.sparkSession
    parsed = cut_lineage(parse(docs, window))
    live = shared_stretches(parsed)
    settled, tables = [live.where("false").select(*_KEY, F.lit(0).alias("lo"), F.lit(0).alias("hi"))], []
    for shared in rounds(_live_symbols(parsed, live, window)):
        tables.append(shared)
        long = shared.where((F.col("words") >= window) & (F.col("least") < F.col("doc_id")))
        settled.append(long.select(*_KEY, F.col("first").alias("lo"), (F.col("first") + F.col("words") - window).alias("hi")))
    settled = cut_lineage(reduce(DataFrame.union, settled))
    for shared in tables:
        drop_folder(shared)
    drop_folder(parsed)
    free_shuffles(spark)
    done = settled.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("done"))
    todo = cut_lineage(live.join(done.hint("merge"), _KEY, "left"))
    texts = docs.join(todo.hint("merge"), _KEY)

    def run(cols):
        p = Parsed(cols["text"].to_pylist(), _words(), window)
        ids, ties = (np.asarray(cols[k]).astype(np.int64) for k in _KEY)
        open_ = np.zeros(len(p.names) + 1, bool)
        for start, live_, done_ in zip(p.starts.tolist(), cols["live"].to_pylist(), cols["done"].to_pylist()):
            for x in live_:
                open_[start + x["lo"] : start + x["hi"] + 1] = True
            for x in done_ or ():
                open_[start + x["lo"] : start + x["hi"] + 1] = False
        at = np.flatnonzero(open_)
        own, (w1, w2) = p.doc[at], p.windows(at)
        return {
            "w1": _signed(w1),
            "w2": _signed(w2),
            "doc_id": pa.array(ids[own]),
            "tie": pa.array(ties[own]),
            "at": pa.array((at - p.starts[own]).astype(np.int32)),
        }

    each = cut_lineage(map_batches(texts.select(*_KEY, "text", "live", "done"), run, "w1 long, w2 long, doc_id long, tie long, at int", TEXT_BYTES))
    free_shuffles(spark)
    # Written first, so that the join has no aggregate below it and a common window can be split.
    least = _shared(each, "w1", "w2")
    free_shuffles(spark)
    some = each.join(least.hint("merge"), ["w1", "w2"]).where("least < doc_id")
    found = settled.union(some.select(*_KEY, F.col("at").alias("lo"), F.col("at").alias("hi")))
    cuts = cut_lineage(found.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")))
    for done in (live, todo, each, least, settled):
        drop_folder(done)
    free_shuffles(spark)
    return cuts


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), removed (spans of words) of every row.

    ``kept`` has the words that stay, joined by one space. Null and empty texts
    have no words; rows without a doc_id lose none, and no other loses one for
    them. Rows that repeat a doc_id don't repeat one another; of documents with
    equal windows only the least doc_id keeps them. Long texts are parsed whole. An
    empty table gives no rows; other columns, whatever their names, are left out.
    """
    cols = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    cuts = repeated_windows(cols.where("doc_id is not null"), window)
    # Texts are shuffled on their own, after the shuffles that lead here are gone.
    joined = cols.join(cuts.hint("merge"), _KEY, "left")

    def run(cols):
        n, gone, kept, spans = [], [], [], []
        for t, cuts in zip(cols["text"].to_pylist(), cols["cuts"].to_pylist()):
            words = split_words(t)
            n.append(len(words))
            if cuts:
                away = np.zeros(len(words) + 1, np.int64)
                for x in cuts:
                    away[x["lo"]] += 1
                    away[x["hi"] + window] -= 1
                cut = np.cumsum(away[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]])))
                words = [w for w, c in zip(words, cut.tolist()) if not c]
                gone.append(int(cut.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            else:
                gone.append(0)
                spans.append([])
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return {"doc_id": cols["doc_id"], "n_words": n, "n_removed": gone, "kept": kept, "removed": spans}

    return map_batches(
        joined.select("doc_id", "text", "cuts"),
        run,
        "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: int, end: int>>",
        TEXT_BYTES,
    )


def digests(deduped: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The registered query in DuckDB: every window by its digest.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h,
        unnest(range(1, len(ws) - 48)) AS i FROM d),
f AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (h) WHERE least < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS n
        FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
