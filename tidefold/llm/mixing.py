"""Mixing sources to target weights by blocks of words.

Each source is one long run of words (documents in a fixed pseudorandom order),
cut into blocks of BLOCK words. The mix is a row of slots dealt into output
shards. Each source's slots fall to the shards in multinomial counts, so that
the sources' totals are met exactly and a shard has SHARD_SLOTS slots but for
chance. The counts are drawn as binomials down a binary tree of shards, from the
root to the shard, each node with a seed of its own and whatever the number of
slots; any task can so find its shard's counts and where each source's slots
begin, without the other shards. Slot k of a source maps through a pseudorandom
permutation of the source's block indices, one permutation for each pass over
the source, and (source, block index) is joined with the blocks. The last slot
of a source takes only the first words of its block, so that a source gives its
target to the word, however few words it has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut_lineage, pieces, small_batches
from .common import mix as mix64

#: Fixed values of the registered query.
WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, SHARD_SLOTS, CHUNK_ROWS, SEED = 128, 8192, 1000, 20_240_229
#: Text that a Python worker takes at a time.
TEXT_BYTES = 8_000_000
#: Chunks whose sizes are summed together before the running sum of a source.
_SUPER = 4096
_BROADCAST_ROWS = 10_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Target of each source; ``sizes`` in the order in which the weights repeat."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    while open_:
        per = left / sum(w[k] for k in open_)
        over = [k for k in open_ if per * w[k] > most * sizes[k]]
        for k in over or open_:
            out[k] = float(most * sizes[k]) if over else per * w[k]
        if not over:
            break
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at k, elementwise for its own n and key.

    Four Feistel rounds on the least even number of bits that holds n, walked on
    until the value is below n.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    n = n.astype(np.uint64)

    def step(x, at):
        left, right = x >> half[at], x & low[at]
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64(r + 1), key[at]) & low[at])
        return left << half[at] | right

    x = k.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = step(x[todo], todo)
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def shard_counts(slots: np.ndarray, shard: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, count) of each source in one output shard."""
    first, colors, lo, hi, node = np.zeros_like(slots), slots, 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, node]).binomial(colors, (mid - lo) / (hi - lo))
        if shard < mid:
            colors, hi, node = left, mid, 2 * node
        else:
            first, colors, lo, node = first + left, colors - left, mid, 2 * node + 1
    return first, colors


def slots_of(size: int, target: float) -> tuple[int, int, int]:
    """(slots, words of the last one, whole passes) of a source of ``size`` words.

    Whole passes take all blocks; the rest takes whole blocks of BLOCK words and
    at last a part of one. Together they hold ``target`` words, rounded.
    """
    if not size:
        return 0, 0, 0
    passes, rest = divmod(round(target), size)
    if not rest:
        return passes * -(-size // BLOCK), BLOCK, passes
    return passes * -(-size // BLOCK) + -(-rest // BLOCK), (rest - 1) % BLOCK + 1, passes


def blocks_at(k: np.ndarray, size: np.ndarray, passes: np.ndarray, key: np.ndarray, most: int = MOST) -> np.ndarray:
    """Block index of slot ``k`` of a source, elementwise; ``key`` is the source's number.

    A pass after the whole ones permutes the full blocks only; the short one at a
    source's end comes last in it.
    """
    n = -(-size // BLOCK)
    turn = k // n
    over = np.where(turn >= passes, size // BLOCK, n)
    at = k % n
    last = at >= over
    key = mix64((key * np.int64(most + 1) + turn).astype(np.uint64), np.uint64(SEED))
    return np.where(last, at, permuted(np.where(last, 0, at), np.maximum(over, 1), key))


def _with_blocks(docs: DataFrame, weights, most, seed) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(rows with sid, at, size; (sid, block) -> times, part; the plan per source).

    ``at`` is a row's first word in its source; (sid, at) is unique among rows with
    words. ``part`` is the number of words that a slot cut short takes of a block.
    """
    spark = docs.sparkSession
    stat = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    stat.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in stat]
    goal = targets(sizes, weights, most)
    cut = [slots_of(s, t) for s, t in zip(sizes, goal)]
    slots, ends, passes = np.array(cut, np.int64).reshape(-1, 3).T
    plan = spark.createDataFrame(
        [(k, r["source"], s, t) for k, (r, s, t) in enumerate(zip(stat, sizes, goal))],
        "sid int, name string, source_size long, target double",
    )
    if len(stat) <= _BROADCAST_ROWS:
        plan = F.broadcast(plan)
    chunks = max(1, sum(r["rows"] for r in stat) // CHUNK_ROWS)
    own = docs.join(plan, docs["source"].eqNullSafe(plan["name"])).drop("name").withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(chunks))
    )
    # Running sums of chunks in two steps, so that no task has all chunks of a source.
    starts = own.groupBy("sid", "chunk").agg(F.sum("size").alias("n")).withColumn("super", F.floor(F.col("chunk") / _SUPER))
    starts = cut_lineage(starts) if chunks > _SUPER else starts
    prior = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = starts.groupBy("sid", "super").agg(F.sum("n").alias("n"))
    sums = sums.select("sid", "super", F.coalesce(F.sum("n").over(prior("sid", "super")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(prior("sid", "super", "chunk")), F.lit(0))
    starts = starts.withColumn("within", within).join(sums.hint("merge"), ["sid", "super"])
    starts = starts.select("sid", "chunk", (F.col("base") + F.col("within")).alias("start"))
    inside = prior("sid", "chunk", F.struct("doc_id", "size", "tie"))
    own = own.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = own.join(starts.hint("merge"), ["sid", "chunk"]).withColumn("at", F.col("start") + F.col("inside")).drop("chunk", "inside", "start", "tie")

    n_shards = max(1, int(slots.sum()) // SHARD_SLOTS)
    n_words = np.array(sizes, np.int64)

    def deal(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, count = shard_counts(slots, shard, n_shards, seed)
                sid = np.repeat(np.arange(len(slots)), count)
                if not len(sid):
                    continue
                k = np.arange(len(sid)) - np.repeat(np.cumsum(count) - count, count) + first[sid]
                block = blocks_at(k, n_words[sid], passes[sid], sid, most)
                words = np.where(k == slots[sid] - 1, ends[sid], BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid, pa.int32()), pa.array(block, pa.int64()), pa.array(words, pa.int32())], names=["sid", "block", "words"]
                )

    dealt = spark.range(0, n_shards, 1, min(n_shards, 4096)).mapInArrow(deal, "sid int, block long, words int")
    whole = F.col("words") == BLOCK
    times = dealt.groupBy("sid", "block").agg(
        F.count(F.when(whole, 1)).alias("times"), F.coalesce(F.max(F.when(~whole, F.col("words"))), F.lit(0)).alias("part")
    )
    return rows, times, [r.asDict() for r in stat]


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each block that a document has words of: sid, at, size, block."""
    block = F.explode(F.sequence(F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)))
    cut = rows.where("size > 0").select("sid", "at", "size", block.alias("block"))
    return cut.select("sid", "at", "size", "block")


def _overlap(words) -> Column:
    """Words of a document among the first ``words`` of a block."""
    first = F.col("block") * BLOCK
    return F.greatest(F.least(first + words, F.col("at") + F.col("size")) - F.greatest(first, "at"), F.lit(0))


def count_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_report(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    A source's taken words add up to its target, rounded. Null and empty texts
    have size 0 and nothing is taken of them; repeated rows are documents of their
    own; a null source is a source, last in order. An empty table gives no rows.
    A long text is one row that lies in many blocks. Other columns of ``docs``,
    whatever their names, are left out.
    """
    sized = cut_lineage(docs.select("doc_id", "source", count_words().alias("size")).withColumn("tie", F.lit(0)))
    rows, times, _ = _with_blocks(sized, weights, most, seed)
    rows = cut_lineage(rows.drop("source"))
    taken = (
        _pieces(rows)
        .join(times.hint("merge"), ["sid", "block"])
        .groupBy("sid", "at")
        .agg(F.sum(_overlap(F.lit(BLOCK)) * F.col("times") + _overlap(F.col("part"))).alias("taken"))
    )
    # A row without words may share its place with the next one.
    return rows.join(
        taken.hint("merge"), (rows["sid"] == taken["sid"]) & (rows["at"] == taken["at"]) & (rows["size"] > 0), "left"
    ).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself, in the columns of ``docs`` (doc_id, text, source and any others).

    A document is returned once for each pass that takes words of it, with the
    words of the blocks taken; a document taken whole keeps its text as it is.
    Documents without words, null texts among them, are in no block and so not in
    the mix. ``n_chars``, if there, is set to the new length. Repeated rows are
    taken on their own; an empty table gives an empty mix; the words of a long
    text are cut at block ends. Other columns are kept under their names.
    """
    names = docs.columns
    packed = docs.select(
        "doc_id", "source", F.struct(*[c for c in names if c != "text"]).alias("row"), "text", count_words().alias("size"), F.xxhash64("text").alias("tie")
    )
    thin = cut_lineage(packed.select("doc_id", "source", "size", "tie"))
    rows, times, _ = _with_blocks(thin.withColumn("tag", F.col("tie")), weights, most, seed)
    rows = cut_lineage(rows.where("size > 0").select("sid", "at", "doc_id", "size", "tag"))
    parts = (
        _pieces(rows)
        .join(times.hint("merge"), ["sid", "block"])
        .groupBy("sid", "at")
        .agg(F.collect_list(F.struct("block", "times", "part")).alias("taken"))
    )
    parts = rows.join(parts.hint("merge"), ["sid", "at"]).select("doc_id", "size", "tag", "at", "taken")
    # Rows that are alike in all of this differ in no way that matters: any of them may have any place.
    nth = Window.partitionBy("doc_id", "size", "tag").orderBy("at")
    parts = parts.withColumn("nth", F.row_number().over(nth))
    alike = Window.partitionBy("doc_id", "size", "tag").orderBy(F.lit(0))
    whole = packed.where("size > 0").withColumnRenamed("tie", "tag").withColumn("nth", F.row_number().over(alike))
    # Joined by a key that rows without a doc_id have too.
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    whole, parts = (x.withColumn("who", who).drop("doc_id") for x in (whole, parts))
    joined = whole.join(parts.hint("merge"), ["who", "size", "tag", "nth"]).select("row", "text", "size", "at", "taken")
    held = joined.schema["row"]

    def cut(batches):
        """Texts per pass; size, at: the row's place; taken: its blocks with their times."""
        for piece in pieces(batches, TEXT_BYTES):
            rows, texts = [], []
            texts_in, sizes, firsts, taken = (piece.column(k).to_pylist() for k in range(1, 5))
            for k, (n, first, t, own) in enumerate(zip(sizes, firsts, texts_in, taken)):
                own, words = sorted((x["block"] * BLOCK - first, x["times"], x["part"]) for x in own), None
                for p in range(1, max(x + (part > 0) for _, x, part in own) + 1):
                    upto = [(b, b + (BLOCK if x >= p else part if x + 1 == p else 0)) for b, x, part in own]
                    spans = [(max(b, 0), min(e, n)) for b, e in upto if e > max(b, 0)]
                    if not spans:
                        continue
                    rows.append(k)
                    if sum(e - s for s, e in spans) == n:
                        texts.append(t)
                        continue
                    words = words or t.encode("utf-8", "surrogatepass").split()
                    texts.append(b" ".join(w for s, e in spans for w in words[s:e]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, piece.column(1).type)], names=["row", "mixed"]
            )

    small_batches(docs.sparkSession)
    out = joined.mapInArrow(cut, T.StructType([held, T.StructField("mixed", T.StringType())]))
    return out.select(
        *[
            F.col("mixed").alias(c) if c == "text" else F.length("mixed").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
            for c in names
        ]
    )
