import math

import numpy as np

from tidefold.llm import embeddings as E

from .conftest import with_clashes


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component) over the least vector of each vec_id."""
    own = {}
    for i, v in rows:
        if i is not None and v is not None and (i not in own or own[i] is None or v < own[i]):
            own[i] = v
        elif i is not None:
            own.setdefault(i, v)
    good = {
        i: np.array(v, float)
        for i, v in own.items()
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    link = {i: set() for i in own}
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    link[a].add(b)
                    link[b].add(a)
    comp = {}
    for i in sorted(link):
        if i in comp:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += link[k]
    return sorted((i, len(link[i]), comp[i]) for i in link)


def check(spark, rows, kind="float"):
    df = with_clashes(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"))
    got = E.near_duplicates(df).collect()
    named = [r for r in got if r.vec_id is not None]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in named) == brute([(r[0], r[1]) for r in rows])
    assert all(r.kept == (r.vec_id == r.component_id) for r in named)
    return got


def test_clusters_chains_and_copies(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((6, 16))
    for k in range(160):
        v = base[k % 6] + rng.standard_normal(16) * (0.02 + 0.3 * (k % 5 == 0))
        rows.append((k * 3 % 160, [float(x) for x in np.float32(v)], k % 2))
    for step in range(12):  # a chain whose ends aren't linked
        a = 0.25 * step
        rows.append((500 + step, [math.cos(a), math.sin(a)] + [0.0] * 14, 0))
    rows += [(700 + k, rows[0][1], 9) for k in range(20)]  # equal vectors
    check(spark, rows)


def test_dense_group_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 40)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(12)
    rows = [(k, [float(x) for x in centre + rng.standard_normal(12) * 0.17], 0) for k in range(150)]
    check(spark, rows, "double")


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0),
        (7, [None, 1.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [], 0), (10, [1e-30, 0.0], 0), (2, [2.0, 0.0], 0),
        (11, [-1.0, 0.0], 0), (12, [3.0], 0), (13, [5.0], None),
    ]
    check(spark, rows)
    got = check(spark, [*rows, (None, [1.0, 0.0], 0)])
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicates(df).collect() == []


def test_threshold_is_met_exactly(spark):
    check(spark, [(1, [1.0, 0.0], 0), (2, [0.95, math.sqrt(1 - 0.95**2)], 0), (3, [0.9499, math.sqrt(1 - 0.9499**2)], 0)], "double")
