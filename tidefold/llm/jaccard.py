"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. A sketch is a row
of bits, each the parity of the shingles that hash to it, so the Hamming distance
of two sketches is at most the size of the sets' symmetric difference. At
similarity 85/100 that difference is at most ``3 a / 17`` for a smaller set of
``a`` shingles. Each size band has a sketch cut into more chunks, of CHUNK_BITS bits each,
than the band's largest difference: two linked sets agree in at least one whole
chunk (pigeonhole), and chunks are the keys of the join. That takes about one
chunk for five shingles, whatever the size of a chunk. Chunks are sparse and never laid out: a chunk's key is
the XOR of a random number for each of its bits that is set. A set is keyed in
the band of its size, and in the one below for partners there. A second, short
sketch of all shingles is kept with each class; its Hamming distance
sifts candidates before they are verified.

Sets that are equal are one class from the start. Classes that share a key are
candidates: first each with the one class of the key that shares most with others
(linear in the key's classes; of near copies that is their source), then, where the classes of a key are still in different components,
all pairs across components whose wide sketches are near enough. All candidates
are verified on the whole texts, so the components are exact, and a group of any
number of near copies needs no pairs within a component.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, connected, cut_lineage, free_shuffles, map_batches, mix, span_hash

#: Similarity as a fraction and words to a shingle.
NUMERATOR, DENOMINATOR, SHINGLE = 85, 100, 4
#: Bits of a chunk of a band's sketch, and 64-bit words of the short sketch.
CHUNK_BITS, SKETCH_WORDS = 1 << 20, 16
#: Text that a Python worker takes at a time.
TEXT_BYTES = 1_000_000
_SKETCH = [f"k{i}" for i in range(SKETCH_WORDS)]


class Sets:
    """Texts -> sorted arrays of distinct shingle hashes."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.hashes = shingle, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # A-Z only
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        return np.unique(span_hash(h, min(self.shingle, len(h)), min(self.shingle, len(h))))


class Bands:
    """Size bands whose smallest and largest sets may just be linked."""

    def __init__(self, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
        self.num, self.den = numerator, denominator
        self.high = [0]

    def difference(self, size: int) -> int:
        """Largest symmetric difference that a linked pair with this smaller size can have."""
        return size * (self.den - self.num) // self.num

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.high.append((self.high[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.high, size))

    def places(self, band: int) -> tuple[int, int]:
        """(chunks of the band's sketches, agreeing ones that a linked pair has at least).

        The sketches of a pair agree in all but ``difference`` chunks. Some more are
        added so that a set has rarely as many empty chunks as must agree.
        """
        least = self.difference(self.high[band]) + 1
        if least == 1:
            return 1, 1
        empty = least * math.exp(-(self.high[band - 1] + 1) / least)
        more = math.ceil(empty + 3 * math.sqrt(empty)) + 1
        return least + more, 1 + more

    def keys(self, s: np.ndarray) -> list[np.ndarray]:
        """Keys of one sorted set: the chunks of its sketch in its bands.

        Empty chunks say little: they are keyed only by a set that has as many
        as must agree. Of a linked pair, either both sets are such, or they agree
        in a chunk that isn't empty.
        """
        own, out = self.of(len(s)), []
        for band in (own - 1, own):
            if band < 1 or band < own and len(s) > self.high[band] * self.den // self.num:
                continue
            places, agree = self.places(band)
            if places == 1:
                continue  # only equal sets, which are one class already
            # Hashes are sorted, so the chunks are too. Two shingles on one bit cancel, as parities do.
            place = ((s >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
            first = np.flatnonzero(np.diff(place, prepend=np.uint64(places)))
            words = np.bitwise_xor.reduceat(mix(s & np.uint64(CHUNK_BITS - 1), np.uint64(5)), first)
            at = place[first]
            if places - len(at) >= agree:
                full = np.zeros(places, np.uint64)
                full[at.astype(np.int64)] = words
                words, at = full, np.arange(places, dtype=np.uint64)
            out.append(mix(mix(words, at), np.uint64(band)))
        return out


def _wide_sketch(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((mix(s, np.uint64(9)) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def set_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n, (s1, s2) signature of the set, k0.. wide parity sketch."""

    sets = Sets(shingle)

    def run(cols):
        n, sig, wide = [], [], []
        for t in cols["text"].to_pylist():
            s = sets.of(t)
            n.append(len(s))
            sig.append(_signature(s))
            wide.append(_wide_sketch(s))
        sketch = np.array(wide, np.int64).reshape(-1, SKETCH_WORDS)
        out = {"doc_id": cols["doc_id"], "n": n, "s1": [a for a, _ in sig], "s2": [b for _, b in sig]}
        return out | {k: pa.array(sketch[:, i]) for i, k in enumerate(_SKETCH)}

    return map_batches(
        docs.select("doc_id", "text"),
        run,
        "doc_id long, n long, s1 long, s2 long, " + ", ".join(f"{k} long" for k in _SKETCH),
        TEXT_BYTES,
    )


def key_table(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(key, s1) for every chunk of every set's sketches; equal sets near one another once."""
    sets, bands, seen = Sets(shingle), Bands(num, den), set()

    def run(cols):
        keys, sigs = [], []
        if len(seen) > 100_000:
            seen.clear()
        for t in cols["text"].to_pylist():
            s = sets.of(t)
            sig = _signature(s) if len(s) else None
            if sig is None or sig in seen:
                continue
            seen.add(sig)
            for k in bands.keys(s):
                keys.append(k)
                sigs.append(np.full(len(k), sig[0], np.int64))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return {"key": pa.array(join(keys).view(np.int64)), "s1": pa.array(join(sigs))}

    return map_batches(docs.select("text"), run, "key long, s1 long", TEXT_BYTES)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b) document ids of those pairs (x, y) of classes that are linked."""
    rep = classes.select("s1", "rep")
    ids = pairs.join(rep.withColumnsRenamed({"s1": "x", "rep": "a"}).hint("merge"), "x").join(
        rep.withColumnsRenamed({"s1": "y", "rep": "b"}).hint("merge"), "y"
    )
    ids = cut_lineage(ids.select("a", "b"))
    need = ids.select(F.col("a").alias("doc_id")).union(ids.select("b")).distinct()
    # A class's documents have equal sets, but one id may stand in several rows of unlike text.
    texts = cut_lineage(docs.select("doc_id", "text").join(need.hint("merge"), "doc_id", "left_semi"))
    free_shuffles(docs.sparkSession)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = ids.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def run(cols):
        sets, memo, a_out, b_out = Sets(shingle), {}, [], []

        def of(t):
            key = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
            if key not in memo:
                if len(memo) >= 64:
                    memo.clear()
                memo[key] = sets.of(t)
            return memo[key]

        for a, b, ta, tb in zip(*(cols[k].to_pylist() for k in ("a", "b", "ta", "tb"))):
            x, y = of(ta or ""), of(tb or "")
            if not len(x) or not len(y) or min(len(x), len(y)) * den < max(len(x), len(y)) * num:
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if den * both >= num * (len(x) + len(y) - both):
                a_out.append(a)
                b_out.append(b)
        return {"a": a_out, "b": b_out}

    return cut_lineage(map_batches(both.select("a", "b", "ta", "tb"), run, "a long, b long"))


def _near(l: str, r: str, num: int, den: int):
    """Whether sizes and wide sketches allow a link between two classes."""
    small, large = F.least(f"{l}.n", f"{r}.n"), F.greatest(f"{l}.n", f"{r}.n")
    apart = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{l}.{k}").bitwiseXOR(F.col(f"{r}.{k}"))) for k in _SKETCH))
    return (small * den >= large * num) & (apart * num <= small * (den - num))


def join_components(
    docs: DataFrame, shingle: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Documents without words have no shingles, are linked with nothing and are
    their own component. Repeated rows give repeated results, an empty table none.
    A long text is one set of all its shingles. Other columns of ``docs``, whatever
    their names, are left out. Equality of sets is judged by 128-bit, candidates by
    64-bit fingerprints.
    """
    docs = docs.select("doc_id", "text")
    sets = cut_lineage(set_table(docs, shingle))
    filled = sets.where("n > 0 and doc_id is not null")
    classes = cut_lineage(
        filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), *[F.min(k).alias(k) for k in _SKETCH])
    )
    # Keys that more than one class has, and how many have each.
    per_key = Window.partitionBy("key")
    shared = cut_lineage(
        key_table(docs.where("doc_id is not null"), shingle, num, den)
        .select("key", "s1", F.min("s1").over(per_key).alias("low"), F.max("s1").over(per_key).alias("high"), F.count("*").over(per_key).alias("n"))
        .where("low < high")
        .select("key", "s1", "n")
        .distinct()
    )
    free_shuffles(docs.sparkSession)
    # The text that others are copies of shares most: it stands for the key.
    support = shared.groupBy("s1").agg(F.sum("n").alias("support"))
    shared = cut_lineage(
        shared.join(support.hint("merge"), "s1").select(
            "key", "s1", F.max(F.struct("support", "s1")).over(per_key)["s1"].alias("head")
        )
    )
    light = classes.select("s1", "n", *_SKETCH)

    def sifted(pairs: DataFrame) -> DataFrame:
        x = light.alias("l").hint("merge")
        y = light.alias("r").hint("merge")
        p = pairs.alias("p")
        return (
            p.join(x, F.col("p.x") == F.col("l.s1"))
            .join(y, F.col("p.y") == F.col("r.s1"))
            .where(_near("l", "r", num, den))
            .select("p.x", "p.y")
        )

    star = shared.where("s1 <> head").select(F.least("s1", "head").alias("x"), F.greatest("s1", "head").alias("y")).distinct()
    edges = _verified(sifted(star), classes, docs, shingle, num, den)
    ids = classes.select(F.col("rep").alias("id")).distinct()
    first = cut_lineage(connected(edges, ids))
    marked = classes.join(first.hint("merge"), classes["rep"] == first["id"]).select("s1", "component", "n", *_SKETCH)
    split = cut_lineage(
        shared.select("key", "s1")
        .join(marked.select("s1", "component").hint("merge"), "s1")
        .select("key", "s1", "component", F.min("component").over(per_key).alias("low"), F.max("component").over(per_key).alias("high"))
        .where("low < high")
        .select("key", "s1", "component")
    )
    wide = split.join(light.hint("merge"), "s1")
    l, r = wide.alias("l"), wide.alias("r").hint("merge")
    across = l.join(
        r, (F.col("l.key") == F.col("r.key")) & (F.col("l.component") < F.col("r.component")) & _near("l", "r", num, den)
    ).select(F.col("l.s1").alias("x"), F.col("r.s1").alias("y")).distinct()
    more = _verified(across, classes, docs, shingle, num, den)
    final = connected(edges.union(more), ids)
    named = classes.join(final.hint("merge"), classes["rep"] == final["id"]).select("s1", "s2", "component")
    return (
        sets.join(named.hint("merge"), ["s1", "s2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def keep_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that of its smallest doc_id.

    Of rows that repeat this doc_id one stays; rows without a doc_id all stay.
    """
    kept = components.where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*docs.columns).union(docs.where("doc_id is null"))


#: The registered query in DuckDB: all pairs with a common shingle, and what they reach.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= {SHINGLE} THEN list_transform(range(1, len(ws) - {SHINGLE - 2}),
        lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS own FROM d),
u AS (SELECT doc_id, len(own) AS n, unnest(own) AS w FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.w = b.w AND a.doc_id < b.doc_id
        AND least(a.n, b.n) * {DENOMINATOR} >= greatest(a.n, b.n) * {NUMERATOR}
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {DENOMINATOR} * count(*) >= {NUMERATOR} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, CAST(len(own) AS BIGINT) AS n_shingles, min(b) AS component_id FROM s JOIN r ON r.a = doc_id GROUP BY doc_id, own
"""
