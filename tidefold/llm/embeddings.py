"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2 - 2c. After a fixed random
rotation the space is cut into BLOCKS blocks of few dimensions; of two linked
vectors at least one block lies within its proportional share of the squared
distance. Each block is a range join on a grid over its first coordinates: a
vector is at home in one cell and visits the neighbouring cells that its range
reaches and that come later in order, so that each pair of vectors meets in one
cell a block. In a cell, block distances pick candidates and the cosine of the
whole vectors, in double precision, decides; a pair counts in the first block
that picks it, so that link counts add up without listing pairs. Cells of more
than CHUNK vectors are dealt as pairs of chunks. Per cell only counts and a
spanning forest of the links leave the task.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut_lineage, map_batches

#: Fixed value of the registered query.
THRESHOLD = 0.95
BLOCKS, CHUNK, SEED = 8, 8192, 11
#: Added to squared distances, far above rounding and far below any that matters.
SLACK = 1e-9


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int = BLOCKS) -> np.ndarray:
    blocks = max(1, min(blocks, dim))
    return np.linspace(0, dim, blocks + 1).astype(int)


def grid_dims(n: int) -> int:
    """Grid coordinates a block: one more for each factor of 4 above 8192 vectors, 6 at most."""
    return int(min(6, max(1, 1 + math.ceil(math.log(max(n, 1) / 8192) / math.log(4)))))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; no component may overflow on the way."""
    matrix = matrix / np.abs(matrix).max(1)[:, None]
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def budget_of(threshold: float, blocks: int) -> float:
    """Squared distance that one block may have to itself."""
    return (2 - 2 * threshold) / blocks + SLACK


def _cells(x: np.ndarray, reach: float, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for every cell that a row is at home in or visits.

    ``x`` has the first g coordinates of a block; cells are 2 * reach wide and
    named by a 64-bit mix of their indices. Visits go to cells later in
    lexicographic order only.
    """
    at = np.floor(x / (2 * reach)).astype(np.int64)
    low = np.floor((x - reach) / (2 * reach)).astype(np.int64) - at  # -1 or 0
    high = np.floor((x + reach) / (2 * reach)).astype(np.int64) - at  # 0 or 1
    rows, cells, home = [], [], []
    for step in itertools.product((-1, 0, 1), repeat=g):
        lead = next((s for s in step if s), 0)
        if lead < 0:
            continue
        s = np.array(step)
        reached = ((s >= low) & (s <= high)).all(1)
        r = np.flatnonzero(reached)
        rows.append(r)
        cells.append(at[r] + s)
        home.append(np.full(len(r), lead == 0))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(home)


def _name(cells: np.ndarray, block: int) -> np.ndarray:
    h = np.full(len(cells), np.uint64(block + 1))
    for k in range(cells.shape[1]):
        h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class _Forest:
    """Spanning forest of the links met so far among n rows."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, i: int, js: np.ndarray) -> None:
        """Links of row i with all rows js."""
        others, at = np.unique(self.label[js], return_index=True)
        new = others != self.label[i]
        if new.any():
            self.edges += [(i, int(j)) for j in js[at[new]]]
            self.label[np.isin(self.label, others[new])] = self.label[i]


def _links(vecs, spins, weights, left, right, block, edges, budget, threshold, counts, forest):
    """Add the links between rows ``left`` and rows ``right`` that count in this block.

    ``right is left`` means pairs within. Everything is a matrix of some rows of
    ``left`` against all of ``right``; no list of pairs is made.
    """
    cuts = list(zip(edges[:-1], edges[1:]))
    norm = [np.einsum("ij,ij->i", spins[:, a:b], spins[:, a:b]) for a, b in cuts[: block + 1]]

    def apart(e, rows, cols):
        a, b = cuts[e]
        return norm[e][rows][:, None] + norm[e][cols] - 2 * (spins[rows, a:b] @ spins[cols, a:b].T)

    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        near = apart(block, rows, right) <= budget
        if right is left:
            near &= right[None, :] > rows[:, None]
        i, j = near.any(1), near.any(0)
        if not i.any():
            continue
        rows, cols, near = rows[i], right[j], near[np.ix_(i, j)]
        if near.sum() * 16 < near.size:  # few candidates: one by one
            x, y = np.nonzero(near)
            ok = np.einsum("ij,ij->i", vecs[rows[x]], vecs[cols[y]]) >= threshold
            x, y = x[ok], y[ok]
            for e in range(block):
                a, b = cuts[e]
                d = spins[rows[x], a:b] - spins[cols[y], a:b]
                later = np.einsum("ij,ij->i", d, d) > budget
                x, y = x[later], y[later]
            linked = np.zeros(near.shape, bool)
            linked[x, y] = True
        else:
            linked = near & (vecs[rows] @ vecs[cols].T >= threshold)
            for e in range(block):  # such a pair counts in that earlier block
                linked &= apart(e, rows, cols) > budget
        if linked.any():
            counts[rows] += linked @ weights[cols]
            counts[cols] += weights[rows] @ linked
            for r in np.flatnonzero(linked.any(1)):
                forest.add(int(rows[r]), cols[linked[r]])


def _join_same_size(classes: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, n_links) partial counts, (a, b) links) among classes of ``dim`` components."""
    turn, edges = rotation(dim), block_edges(dim)
    blocks = len(edges) - 1
    budget = budget_of(threshold, blocks)
    reach = math.sqrt(budget + SLACK)
    g = min(grid_dims(classes.count()), int(np.diff(edges).min()))

    def place(cols):
        ids = np.asarray(cols["id"])
        data = np.array(cols["embedding"].flatten(), np.float64).reshape(-1, dim)
        spins = unit_rows(data) @ turn
        rows, names, homes, which = [], [], [], []
        for b in range(blocks):
            r, cells, home = _cells(spins[:, edges[b] : edges[b] + g], reach, g)
            rows.append(r)
            names.append(_name(cells, b))
            homes.append(home)
            which.append(np.full(len(r), b))
        rows = pa.array(np.concatenate(rows))
        return {
            "cell": pa.array(np.concatenate(names)),
            "block": pa.array(np.concatenate(which), pa.int32()),
            "home": pa.array(np.concatenate(homes)),
            "id": pa.array(ids).take(rows),
            "weight": cols["weight"].take(rows),
            "embedding": cols["embedding"].take(rows),
        }

    kind = classes.schema["embedding"].dataType.simpleString()
    members = map_batches(
        classes.select("id", "weight", "embedding"), place, f"cell long, block int, home boolean, id long, weight long, embedding {kind}"
    )
    sizes = members.select("cell", "block").groupBy("cell", "block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # Chunk c of a cell goes to the tasks (c, d) and (d, c); a cell that fits one chunk is one task.
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = (
        members.join(sizes.hint("merge"), ["cell", "block"])
        .withColumn("own", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "cell",
            "block",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") <= F.col("other")).alias("first"),
            "home",
            "id",
            "weight",
            "embedding",
        )
    )

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        block = t["block"][0].as_py()
        ids = np.asarray(t["id"])
        weights = np.asarray(t["weight"]).astype(np.float64)
        home = np.array(t["home"])
        vecs = unit_rows(np.array(t["embedding"].combine_chunks().flatten(), np.float64).reshape(-1, dim))
        spins = vecs @ turn
        counts, forest = np.zeros(len(ids)), _Forest(len(ids))
        rest = (vecs, spins, weights)
        how = (block, edges, budget, threshold, counts, forest)
        at = np.flatnonzero(home)
        if t["low"][0].as_py() == t["high"][0].as_py():
            _links(*rest, at, at, *how)
            _links(*rest, at, np.flatnonzero(~home), *how)
        else:
            first = np.array(t["first"])
            _links(*rest, np.flatnonzero(first & home), np.flatnonzero(~first), *how)
            _links(*rest, np.flatnonzero(first & ~home), np.flatnonzero(~first & home), *how)
        some = np.flatnonzero(counts)
        a = np.array([x for x, _ in forest.edges], np.int64)
        b = np.array([y for _, y in forest.edges], np.int64)
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], ids[a]]).astype(np.int64)),
                "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[b].astype(np.int64)]), mask=np.arange(len(some) + len(a)) < len(some)),
                "n": pa.array(np.concatenate([counts[some].astype(np.int64), np.zeros(len(a), np.int64)])),
            }
        )

    found = cut_lineage(dealt.groupBy("cell", "block", "low", "high").applyInArrow(meet, "a long, b long, n long"))
    return (
        found.where("b is null").select(F.col("a").alias("id"), F.col("n").alias("n_links")),
        found.where("b is not null").select("a", "b"),
    )


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each vec_id.

    Vectors that are null, zero or hold a null or non-finite component, and rows
    without a vec_id, are linked with nothing. Of rows that repeat a vec_id the
    least vector counts. Vectors of unlike length are not linked. Equal vectors
    are joined once, with their number as weight.
    """
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    ok = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = cut_lineage(rows.withColumn("ok", ok))
    good = rows.where("ok")
    classes = cut_lineage(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    dims = sorted(r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().collect())
    counts = classes.where("false").select("id", F.lit(0).cast("long").alias("n_links"))
    links = classes.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))
    for d in dims:
        c, e = _join_same_size(classes.where(F.size("embedding") == d), d, threshold)
        counts, links = counts.union(c), links.union(e)
    total = counts.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    named = connected(links, classes.select("id"))
    info = (
        classes.join(total.hint("merge"), "id", "left")
        .join(named.hint("merge"), "id")
        .select("embedding", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    )
    joined = good.select("vec_id", "embedding").join(info.hint("merge"), "embedding").select("vec_id", "n_links", "component")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    nameless = vectors.where("vec_id is null").select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    return joined.union(alone).union(nameless).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("n_links").cast("long").alias("n_links"),
        F.col("component").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


#: The registered query in DuckDB: all pairs, and what they reach.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
