import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import bpe as B

VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def pair():
    own = B.loaded(*VOCABULARY)
    return own, tiktoken.Encoding("t", pat_str=VOCABULARY[1], mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=80))
def test_any_text(text):
    own = B.loaded(*VOCABULARY)
    other = tiktoken.Encoding("t", pat_str=VOCABULARY[1], mergeable_ranks=own.ranks, special_tokens={})
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_text_of_vocabulary_pieces(pair):
    own, other = pair
    rng = random.Random(12)
    tokens = [t.decode() for t in own.ranks if t.isascii()]
    for _ in range(400):
        text = "".join(rng.choice(tokens) for _ in range(rng.randrange(40)))
        assert own.encode(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 20_000, "ab" * 9000, "=" * 7000, " " * 5000 + "x", "\n" * 3000, "<|endoftext|>", "é" * 4000])
def test_long_and_odd_texts(pair, text):
    own, other = pair
    assert own.encode(text) == other.encode_ordinary(text)


def test_small_vocabulary_with_backtracking():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258, b"cd": 259, b"bcd": 260}
    own, other = B.BacktrackingBpe(ranks, r"\S+|\s+"), tiktoken.Encoding("s", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(14)))
        assert own.encode(text) == other.encode_ordinary(text)


def test_query_and_columns(spark, documents, pair):
    _, other = pair
    rows = [(1, None), (2, ""), (3, "Hello  wörld\n"), (3, "Hello  wörld\n"), (None, "x"), (4, "lorem ipsum " * 20_000)]
    df = documents(rows)
    got = B.encode_digests(df, *VOCABULARY).collect()
    want = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    coded = B.encode(df, *VOCABULARY)
    assert coded.columns == [*df.columns, "ids"]
    back = B.decode(coded, *VOCABULARY)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert B.encode_digests(df.limit(0), *VOCABULARY).collect() == []
