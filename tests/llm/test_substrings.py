import hashlib
import random
import re

import numpy as np
import pytest

from tidefold.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        cut = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    cut[k : k + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(documents, rows):
    got = S.digests(S.dedup(documents(rows)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_shared_passages_of_every_kind(documents):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(80)]
    rows = []
    for i in range(12):
        text = [word() for _ in range(rng.randrange(10, 120))]
        if i % 3:
            at = rng.randrange(len(text))
            a = rng.randrange(0, 40)
            text[at:at] = passage[a : a + rng.randrange(45, 80)]
        rows.append((i * 7 % 12, " \t\n "[i % 3].join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1]), (101, rows[3][1])]
    check(documents, rows)


def test_runs_and_periods(documents):
    rng = random.Random(2)
    rows = []
    for i in range(24):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
            parts += unit * rng.randrange(1, 60)
        rows.append((i, " ".join(parts)))
    check(documents, rows)


def test_nulls_empty_and_long_texts(documents):
    long = " ".join(str(k % 997) for k in range(60_000))
    same = " ".join(f"x{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, long), (5, "a " * 49), (None, same), (6, same), (None, None), (7, same + " y")]
    check(documents, rows)


def test_empty_table(documents):
    assert S.dedup(documents([(1, "a")]).limit(0)).collect() == []


def test_every_window_has_a_name_that_equal_windows_share():
    rng = random.Random(3)
    for alphabet in (1, 2, 3, 30, 5000):
        shared = [f"t{rng.randrange(alphabet)}" for _ in range(50)]
        texts = []
        for _ in range(30):
            a = [f"t{rng.randrange(alphabet)}" for _ in range(rng.randrange(60))]
            b = [f"t{rng.randrange(alphabet)}" for _ in range(rng.randrange(60))]
            texts.append((len(a), " ".join(a + shared + b)))
        p = S.Parsed([t for _, t in texts], S.Words())
        p.first_round()
        room = np.repeat(p.ends, p.ends - p.starts) - np.arange(len(p.names))
        name = {int(w): int(x) for x, lo, hi in zip(p.anchor, p.lo, p.hi) for w in range(lo, hi + 1)}
        assert sorted(name) == np.flatnonzero(room >= 50).tolist()
        assert len({name[int(p.starts[k]) + n] for k, (n, _) in enumerate(texts)}) == 1


def test_high_symbols_are_shared_across_partitions(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(900)]
    rows = [(k, " ".join([word() for _ in range(rng.randrange(200))] + passage + [word() for _ in range(30)])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").withColumn("tie", F.lit(0).cast("long"))
    assert docs.select(F.spark_partition_id()).distinct().count() > 2
    parsed = S.parse(docs)
    state = S._live_symbols(parsed, S.shared_stretches(parsed), S.WINDOW)
    text, grown, most = {k: t.split() for k, t in rows}, [], dict.fromkeys(range(8), 0)
    for shared in S.rounds(state):
        found = shared.collect()
        for r in found:  # a name stands for the same words everywhere
            low = next(x for x in found if (x.a, x.b, x.doc_id) == (r.a, r.b, r.least))
            assert text[r.doc_id][r.first : r.first + r.words] == text[r.least][low.first : low.first + low.words]
            most[r.doc_id] = max(most[r.doc_id], r.words)
        grown.append(max(r.words for r in found))
    assert grown[0] < 300 < grown[-1] and min(most.values()) > 100


def test_rows_of_one_id_and_unlike_texts_lose_only_their_own_windows(documents):
    one, two = (" ".join(f"{c}{k}" for k in range(90)) for c in "xy")
    check(documents, [(1, one), (2, one), (2, two + " " + two), (3, two), (2, "z " * 70), (2, one)])


def test_kept_text_and_spans(documents):
    same = " ".join(f"x{k}" for k in range(50))
    rows = {r.doc_id: r for r in S.dedup(documents([(1, same), (2, "a " + same + " b")])).collect()}
    assert rows[1].kept == same and rows[1].removed == []
    assert rows[2].kept == "a b" and [(s.start, s.end) for s in rows[2].removed] == [(1, 51)]


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 4000])
def test_symbols_grow_and_keep_all_words(n):
    a = np.arange(n, dtype=np.uint64) % np.uint64(700)
    s = S.Symbols(a, a + np.uint64(1), np.ones(n, np.int64), np.arange(n) // 1000)
    for round_ in range(3):
        s.grow(round_)
        assert s.words.sum() == n and (np.bincount(s.seq, s.words) <= 1000).all()
    assert n < 4000 or len(s) < n / 30
