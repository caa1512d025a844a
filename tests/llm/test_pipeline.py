"""The pipeline over a small corpus against plain versions of its stages."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from tidefold.llm import bpe, mixing, secrets, toxicity

from .test_jaccard import brute as components
from .test_mixing import WORD

VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def rows():
    rng = random.Random(16)
    word = lambda: rng.choice("bcdf") + rng.choice("aeiou") + rng.choice("lmnr") + rng.choice("aeiou") + rng.choice("st")
    out = []
    for i in range(160):
        text = " ".join(word() for _ in range(rng.randrange(20, 150)))
        if i % 5 == 0:
            text += " vilescum nastyrot " + word()
        if i % 7 == 0:
            text += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
        out.append((i, text, "en", rng.choice("abc"), len(text)))
    copies = [(200 + k, out[k + 1][1] + (" more" if k % 2 else ""), "en", "d", 0) for k in range(12)]
    return [*out, *copies, (300, None, "en", "a", 0), (301, "", None, None, None)]


@pytest.fixture
def tables(spark, tmp_path):
    own = rows()
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int("vilescum" in (r[1] or ""))) for r in own if r[0] < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = []
    for name, stage in P.STAGES:
        docs = P.cut_lineage(stage(spark, docs, tables))
        steps.append(docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == list(P.COLUMNS)
    clean, single, masked, mixed, coded = ({} for _ in range(5))
    # Toxicity: by the scorer itself, one text at a time.
    net = toxicity.fit(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    scorer = net.scorer()
    want = {r[0]: r[1] for r in rows() if scorer.scores([r[1]])[0] < 0.5}
    clean = {r.doc_id: r.text for r in steps[0].collect()}
    assert clean == want
    assert not any("vilescum" in (t or "") for t in clean.values()) and len(clean) > 120
    # Near copies: all pairs.
    keep = {c for _, _, c in components(list(clean.items()))}
    single = {r.doc_id: r.text for r in steps[1].collect()}
    assert single == {i: clean[i] for i in keep}
    assert not set(single) & set(range(200, 212)) - {200 + k for k in range(12) if k + 1 not in clean}
    # Secrets: each text by itself.
    find = secrets._encoder(*VOCABULARY).encode_ordinary
    for r in steps[2].collect():
        t = single[r.doc_id]
        masked[r.doc_id] = r.text
        if t and secrets.scan_batch([t], find)[0]:
            assert "[SECRET]" in r.text and "04dbebab" not in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == t
    # Mix: words of each document as often as its blocks are taken.
    size, taken, source = {}, defaultdict(int), {}
    for r in steps[2].collect():
        size[r.doc_id], source[r.doc_id] = len(WORD.findall(r.text or "")), r.source
    for r in steps[3].collect():
        mixed.setdefault(r.doc_id, []).append(r.text)
        taken[r.source] += len(WORD.findall(r.text))
        assert not Counter(WORD.findall(r.text)) - Counter(WORD.findall(masked[r.doc_id]))
    assert all(len(v) <= 3 for v in mixed.values())
    by_source = defaultdict(int)
    for i, n in size.items():
        by_source[source[i]] += n
    names = sorted(s for s in by_source if s is not None) + [None] * (None in by_source)
    for s, goal in zip(names, mixing.targets([by_source[s] for s in names])):
        assert abs(taken[s] - goal) <= mixing.BLOCK + 0.02 * goal
    # BPE: by the library.
    other = tiktoken.Encoding("p", pat_str=VOCABULARY[1], mergeable_ranks=bpe.load_ranks(VOCABULARY[0]), special_tokens={})
    want = []
    for i, texts in mixed.items():
        for t in texts:
            ids = np.array(other.encode_ordinary(t), "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    coded = sorted(tuple(r)[:4] for r in steps[4].collect())
    assert coded == sorted(want)


def test_near_copies_go_at_five_words_and_four_fifths(spark):
    rng = random.Random(5)
    docs = []
    for size in (6, 12, 40, 150, 500):
        for _ in range(4):
            w = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for cut in (0.03, 0.09, 0.1, 0.12, 0.17, 0.2, 0.24):
                n = int(size * cut)
                a = rng.randrange(size - n + 1)
                docs.append([*w[:a], *(f"e{rng.randrange(10**6)}" for _ in range(n)), *w[a + n :]])
                docs.append([*w, *(f"a{rng.randrange(10**6)}" for _ in range(n))])
            docs.append(w)
    rng.shuffle(docs)

    def kept(words, num):
        """Ids of the smallest document of each component, all pairs of one base compared."""
        sets = [{tuple(d[k : k + words]) for k in range(max(1, len(d) - words + 1))} for d in docs]
        up = list(range(len(docs)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(x & y)
                if 100 * both >= num * (len(x) + len(y) - both):
                    p, q = sorted((root(i), root(j)))
                    up[q] = p
        return {i for i in up if up[i] == i}

    assert kept(5, 80) < kept(4, 85)
    table = [(i, " ".join(d), "en", "a", 0) for i, d in enumerate(docs)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.keep_one_of_near_copies(spark, df, "").collect()} == kept(5, 80)


def test_run_gives_what_the_stages_give(spark, tables):
    assert P.run(spark, tables).count() > 100


def test_empty_tables_repeated_rows_long_texts_and_clashing_columns(spark, tmp_path):
    from .conftest import with_clashes

    long = " ".join(f"w{k % 4001}" for k in range(60_000))
    odd = [(1, "same row here", "en", "a", 13), (1, "same row here", "en", "a", 13), (2, long, None, None, None), (None, "no id", "en", "a", 5), (3, None, "en", "b", 0)]
    for name, own in (("none", []), ("odd", odd)):
        docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
        with_clashes(docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
    got = P.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} == {None, 1, 2} and len({r.ids_sha256 for r in got if r.doc_id == 1}) == 1


def test_registration():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert queries["pipeline"] is P.run
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1
    assert set(entry.oracle_sql()) <= set(queries)
