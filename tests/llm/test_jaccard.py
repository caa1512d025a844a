import random
import re

import numpy as np

from tidefold.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return sorted(((i, len(s), root(i) if i is not None and s else i) for i, s in sets), key=repr)


def check(documents, rows):
    got = J.join_components(documents(rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    return got


def near_copies(rng, n, size, count, edits):
    base = [f"w{rng.randrange(900)}" for _ in range(size)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append((n + len(out), " ".join(w)))
    return out


def test_near_copies_of_all_sizes(documents):
    rng = random.Random(7)
    rows = []
    for size in (4, 7, 12, 30, 90, 250, 900):
        rows += near_copies(rng, len(rows), size, 10, max(1, size // 25))
    rng.shuffle(rows)
    check(documents, rows)


def test_a_large_group_of_near_copies(documents):
    rng = random.Random(8)
    check(documents, near_copies(rng, 0, 120, 120, 5))


def test_odd_rows(documents):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "One two three"), (8, "É one two three four"),
        (9, "é one two three four"), (None, "one"), (None, None), (4, "one"), (10, "go " * 20_000), (11, "go " * 30), (12, "one two three"),
    ]
    check(documents, rows)


def test_keep_first(documents):
    rows = [(5, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (9, "other text of its own"), (None, "a b c d e"), (7, None)]
    df = documents(rows)
    kept = J.keep_first(df, J.join_components(df))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "9", "None"]


def test_empty_table(documents):
    assert J.join_components(documents([(1, "a")]).limit(0)).collect() == []


def test_linked_sets_share_a_key():
    rng, bands = np.random.default_rng(9), J.Bands()
    for _ in range(400):
        n = int(np.exp(rng.uniform(np.log(6), np.log(3000))))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(rng.integers(0, bands.difference(n) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone // 2 :], rng.integers(0, 2**64, gone - gone // 2, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        union = len(a) + len(b) - both
        if 100 * both >= 85 * union and union > both:
            assert len(np.intersect1d(np.concatenate(bands.keys(a)), np.concatenate(bands.keys(b))))
