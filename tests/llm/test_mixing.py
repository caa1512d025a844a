import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidefold.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(rng, n, most=900):
    return [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(most))) for _ in range(n)]


def check(documents, rows):
    got = M.mix_report(documents(rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    goal = dict(zip(names, M.targets([sizes[s] for s in names])))
    want = sorted(((i, len(WORD.findall(t or "")), sizes[s], goal[s]) for i, t, s in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size, r.target) for r in got), key=repr) == want
    assert all(0 <= r.taken <= M.MOST * r.size for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
    for s in names:
        if len({sizes[x] for x in names}) == len(names):
            assert taken[sizes[s]] == round(goal[s])
    return got


def taken_by_a_plain_loop(rows):
    """Words taken of each (doc_id, source): every slot of every source, one by one, over a list of its words."""
    by_source = defaultdict(list)
    for i, t, s in rows:
        by_source[s].append((i, len(WORD.findall(t or ""))))
    names = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    goal = M.targets([sum(n for _, n in by_source[s]) for s in names])
    out = defaultdict(int)
    chunks = max(1, len(rows) // M.CHUNK_ROWS)
    assert chunks == 1  # documents of one chunk are in order of their id
    for number, (s, target) in enumerate(zip(names, goal)):
        words = [i for i, n in sorted(by_source[s]) for _ in range(n)]
        slots, last, passes = M.slots_of(len(words), target)
        for k in range(slots):
            one = lambda x: np.array([x], np.int64)
            block = int(M.blocks_at(one(k), one(len(words)), one(passes), one(number))[0])
            for i in words[block * M.BLOCK : (block + 1) * M.BLOCK][: last if k == slots - 1 else M.BLOCK]:
                out[i, s] += 1
    return out


def test_targets_meet_their_limits():
    assert M.targets([]) == [] and M.targets([0, 0]) == [0.0, 0.0]
    assert M.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(rng.randrange(1, 12))]
        t = M.targets(sizes)
        assert sum(t) == pytest.approx(sum(sizes))
        assert all(a <= 3 * s * (1 + 1e-12) for a, s in zip(t, sizes))
        w = [M.WEIGHTS[k % 3] for k in range(len(sizes))]
        free = {round(a / b, 6) for a, b, s in zip(t, w, sizes) if a < 3 * s * (1 - 1e-9)}
        assert len(free) <= 1  # those below the limit share by weight


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        k = np.arange(n)
        for key in (0, 5, 2**63):
            p = M.permuted(k, np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(p.tolist()) == list(range(n))
    a = M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1, np.uint64))
    assert abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


@pytest.mark.parametrize("shards", [1, 2, 3, 8, 13])
def test_shard_counts_add_up(shards):
    slots = np.array([500, 0, 37, 1200, 1], np.int64)
    at = np.zeros_like(slots)
    for s in range(shards):
        first, count = M.shard_counts(slots, s, shards)
        assert (first == at).all() and (count >= 0).all()
        assert abs(count.sum() - slots.sum() / shards) <= 6 * (slots.sum() / shards) ** 0.5
        at = at + count
    assert (at == slots).all()


def test_draws_scatter_alike_at_every_number_of_slots():
    for total in (10**6, 8 * 10**8, 10**9, 5 * 10**13):
        slots = np.array([total, total // 7, 7], np.int64)
        draws = np.array([M.shard_counts(slots, 0, 2, seed)[1] for seed in range(300)])
        spread = (draws[:, 0] - total / 2) / (total / 4) ** 0.5
        assert abs(spread.mean()) < 0.25 and 0.85 < spread.std() < 1.15
        first, count = M.shard_counts(slots, 123_456, 10**6)
        assert (count <= slots).all() and (first <= slots).all()


def test_slots_hold_the_target_to_the_word():
    rng = random.Random(18)
    for _ in range(3000):
        size = rng.choice([1, 5, 127, 128, 129, 256, 1000, rng.randrange(1, 5000)])
        target = rng.choice([0, size, 2 * size, 3 * size, rng.uniform(0, 3 * size)])
        slots, last, passes = M.slots_of(size, target)
        k = np.arange(slots)
        block = M.blocks_at(k, np.full(slots, size), np.full(slots, passes), np.zeros(slots, np.int64))
        words = np.minimum(M.BLOCK, size - block * M.BLOCK)
        if slots:
            assert words[-1] >= last or last == M.BLOCK
            words[-1] = min(words[-1], last)
        assert words.sum() == round(target)
        assert slots == 0 or np.bincount(block).max() <= 3


def test_small_sources_meet_their_targets(documents):
    rows = [(k, " ".join(f"w{j}" for j in range(100)), s) for k, s in enumerate("abc")]
    assert [r.taken for r in sorted(check(documents, rows))] == [188, 75, 38]


def test_taken_as_by_a_plain_loop(documents):
    rng = random.Random(19)
    rows = [(k, t, rng.choice(["a", "a", "b", None])) for k, t in enumerate(texts(rng, 80))]
    want = taken_by_a_plain_loop(rows)
    source = {i: s for i, _, s in rows}
    got = M.mix_report(documents(rows)).collect()
    assert {r.doc_id: r.taken for r in got} == {i: want[i, s] for i, s in source.items()}


def test_mix_of_uneven_sources(documents):
    rng = random.Random(14)
    rows = [(k, t, rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for k, t in enumerate(texts(rng, 150))]
    rows += [(500, None, "a"), (501, "", "b"), (502, "one", "tiny"), (None, "no id here", "b"), (7, rows[7][1], rows[7][2])]
    first = check(documents, rows)
    again = M.mix_report(documents(list(reversed(rows)))).collect()
    assert sorted(first, key=repr) == sorted(again, key=repr)


def test_long_text_and_nothing(documents):
    check(documents, [(1, "w " * 50_000, "a"), (2, "x y", "b")])
    got = M.mix_report(documents([(1, "", "a"), (2, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert M.mix_report(documents([(1, "a")]).limit(0)).collect() == []


def test_documents_of_the_mix_have_the_words_of_the_report(documents):
    rng = random.Random(15)
    rows = [(k, t, rng.choice("abc")) for k, t in enumerate(texts(rng, 60))] + [(3, "same row", "a"), (3, "same row", "a")]
    df = documents(rows)
    report = defaultdict(int)
    for r in M.mix_report(df).collect():
        report[r.doc_id] += r.taken
    mixed = M.mix_documents(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    source = {i: t for i, t, _ in rows}
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
        if r.doc_id != 3:
            assert set(WORD.findall(r.text)) <= set(WORD.findall(source[r.doc_id]))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in report.items() if v}
