import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}" for _ in range(rng.randrange(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilescum", "nastyrot", "Vilescum!"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = corpus(300, 1)
    return T.train([r[1] for r in rows], [r[2] for r in rows], 0.25, epochs=6)


def test_learns_and_scores_new_texts(net):
    rows = corpus(200, 2)
    scores = net.scorer().scores([r[1] for r in rows])
    assert ((scores >= 0.5) == np.array([r[2] for r in rows], bool)).mean() > 0.95


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = T.Network.fresh(3)
    for k, v in net.p.items():
        net.p[k] = (rng.standard_normal(v.shape) * 0.3).astype(np.float64)
    x = rng.standard_normal((9, T.WORD_DIM + T.CHAR_DIM)) * 0.5
    ids = rng.integers(1, 9, (3, T.WINDOW))
    ids[1, 40:] = 0
    y, w = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.7])

    def loss():
        z = net.run({k: net.project(x, k) for k in "fb"}, ids).astype(np.float64)
        return float((w * (np.logaddexp(0, z) - y * z)).sum())

    g, dx = net.gradients(x, ids, y, w)
    for name in ("Wf", "Ub", "cf", "A", "v", "o", "b"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at]), name
    old = x[4, 2]
    x[4, 2] = old + 1e-3
    up = loss()
    x[4, 2] = old - 1e-3
    down = loss()
    assert abs((up - down) / 2e-3 - dx[4, 2]) < 2e-3 + 0.02 * abs(dx[4, 2])


def test_windows_cover_every_word_and_overlap():
    for n in (1, 63, 64, 65, 96, 97, 1000):
        starts = T.windows(n)
        covered = set()
        for s in starts:
            covered |= set(range(s, min(s + T.WINDOW, n)))
        assert covered == set(range(n))
        assert (np.diff(starts) <= T.STRIDE).all()


def test_score_does_not_depend_on_the_batch(net):
    texts = [r[1] for r in corpus(40, 5)] + ["", None, "x" * 5000, "word " * 3000]
    together = net.scorer().scores(texts)
    alone = np.array([net.scorer().scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-4)
    assert together[40] == together[41] == 0


def plain_score(net, text):
    """A text's score by the definition: one window, one word and one unit at a time."""
    import math

    sig = lambda x: 1 / (1 + math.exp(-x))
    p, h, words = {k: v.astype(float) for k, v in net.p.items()}, T.HIDDEN, T.words_of(text)
    worst = -math.inf
    for start in T.windows(len(words)):
        inputs = []
        for w in words[start : start + T.WINDOW]:
            row, grams, _ = T.word_inputs([w])
            chars = [sum(p["Ec"][g][j] for g in grams) / math.sqrt(len(grams)) for j in range(T.CHAR_DIM)]
            inputs.append([*p["Ew"][row[0]], *chars])
        states = [[] for _ in inputs]
        for k in "fb":
            s = [0.0] * h
            for t in range(len(inputs)) if k == "f" else range(len(inputs) - 1, -1, -1):
                x = [sum(a * p[f"W{k}"][i][j] for i, a in enumerate(inputs[t])) + p[f"c{k}"][j] for j in range(3 * h)]
                back = lambda v, j: sum(a * p[f"U{k}"][i][j] for i, a in enumerate(v))  # noqa: B023, E731
                z = [sig(x[j] + back(s, j)) for j in range(h)]
                r = [sig(x[h + j] + back(s, h + j)) for j in range(h)]
                rs = [a * b for a, b in zip(r, s)]
                s = [s[j] + z[j] * (math.tanh(x[2 * h + j] + back(rs, 2 * h + j)) - s[j]) for j in range(h)]
                states[t] += s
        hidden = [[math.tanh(sum(a * p["A"][i][j] for i, a in enumerate(s))) for j in range(h)] for s in states]
        weight = [math.exp(sum(a * b for a, b in zip(e, p["v"]))) for e in hidden]
        pooled = [sum(w * s[j] for w, s in zip(weight, states)) / sum(weight) for j in range(2 * h)]
        worst = max(worst, sum(a * b for a, b in zip(pooled, p["o"])) + p["b"][0])
    return sig(worst - net.shift)


def test_scores_match_a_plain_loop(net):
    texts = [r[1] for r in corpus(6, 8)] + ["one", "a" * 60 + " !! b", " ".join(f"w{k}" for k in range(150))]
    got = net.scorer().scores(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)


def test_query_columns_and_odd_rows(spark, documents, net):
    rows = [(1, "vilescum nastyrot vilescum"), (2, None), (3, ""), (None, "bala cedo"), (1, "vilescum nastyrot vilescum"), (4, "fila " * 4000)]
    got = T.score(documents(rows), net).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert [r.predicted for r in got if r.doc_id == 1] == [1, 1]
    kept = T.reject(documents(rows), net)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "None"]
    assert kept.columns == documents(rows).columns


def test_fit_leaves_out_held_out_rows_and_odd_labels(spark, documents, monkeypatch):
    seen = {}
    monkeypatch.setattr(T, "train", lambda texts, labels, share: seen.update(n=len(texts), labels=labels, share=share))
    docs = documents([(i, f"text {i}") for i in range(60)])
    labels = spark.createDataFrame(
        [(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (7, 1, None), (8, 0, 5)], "doc_id long, quality int, toxic int"
    )
    T.fit(docs, labels, per_class=1000)
    assert seen["n"] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    T.fit(docs.union(docs.where("doc_id = 2").withColumn("text", F.repeat(F.lit("ab "), T.MOST_CHARS))), labels, per_class=1000)
    assert seen["n"] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    T.fit(docs, labels, per_class=5)
    assert seen["n"] == 10 and sum(seen["labels"]) == 5


def test_nothing_to_learn_from(spark, documents):
    docs = documents([(1, "a b"), (2, "")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score(docs, T.fit(docs, none)).collect()] == [0.0, 0.0]
    assert T.score(docs.limit(0), T.fit(docs, none)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = T.score(docs, T.fit(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    right = scored.predicted == scored.toxic
    assert right.mean() > 0.95
    assert right[scored.toxic == 0].mean() > 0.97
    assert right[scored.toxic == 1].mean() > 0.75
