import random

import numpy as np

from tidefold.llm import common as C


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(18)
    ids = rng.sample(range(10_000), 700)
    edges = list(zip(ids[:300], ids[1:300]))  # a chain in random order
    edges += [(ids[300], x) for x in ids[301:400]]  # a star
    edges += list(zip(ids[400:450], ids[401:450])) + [(ids[449], ids[400])]  # a cycle
    edges += [(ids[500], ids[500]), (ids[501], ids[502]), (ids[502], ids[501]), (ids[501], ids[502])]
    rng.shuffle(edges)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = C.connected(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i,) for i in ids], "id long"))
    assert {r.id: r.component for r in got.collect()} == {i: root(i) for i in ids}


def test_components_without_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    got = C.connected(none, spark.createDataFrame([(3,), (1,)], "id long"))
    assert sorted((r.id, r.component) for r in got.collect()) == [(1, 1), (3, 3)]


def test_span_names_depend_on_every_word_and_the_order():
    h = np.arange(40, dtype=np.uint64)
    for width in (1, 2, 3, 7, 16, 31):
        names = C.span_hash(h, width)
        assert len(names) == 40 - width + 1 and len(set(names.tolist())) == len(names)
        again = C.span_hash(np.concatenate([h[5:], h]), width)
        assert again[0] == names[5] and again[35] == names[0]
    assert len(C.span_hash(h[:3], 4)) == 0


def test_pieces_keep_all_rows_and_stay_small():
    import pyarrow as pa

    texts = ["x" * n for n in (0, 5, 50, 500, 3, 0, 99, 1)] + [None, "y" * 40]
    batch = pa.RecordBatch.from_pydict({"n": list(range(10)), "text": texts})
    parts = list(C.pieces([batch, batch.slice(0, 0)], 100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)


def test_small_batches_keep_a_smaller_setting(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "50")
        C.small_batches(spark)
        assert spark.conf.get(name) == "50"
        spark.conf.set(name, "0")
        C.small_batches(spark)
        assert spark.conf.get(name) == "2000"
    finally:
        spark.conf.set(name, before)
