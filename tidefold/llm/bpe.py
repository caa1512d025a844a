"""Byte-level BPE by backtracking over an Aho-Corasick automaton.

Token byte strings are mapped to Latin-1 text, one character a byte, so that
pyahocorasick can hold them. For a piece of text the automaton gives, for every
start, the longest vocabulary entry. The encoder walks left to right with these
longest matches. A token is accepted only if it can stand beside the token
before it, that is, if merging the two tokens' joint bytes by rank ends in just
these two (memoised per pair); else it falls back to the next shorter entry that
starts there, and when none is left, to the token before. A start that failed is
never tried again, so the work is linear in the piece. A sequence whose
neighbours are all compatible is the sequence of the merge rules, as a merge
across a boundary would show in the two tokens beside it alone.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_batches

_NO_RANK = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BacktrackingBpe:
    """Exact BPE ids for one vocabulary of ranks; ranks are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_limit: int = 200_000):
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.table[i] = token
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter_memo: dict[int, int] = {}
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cache_limit = cache_limit

    def _merged(self, data: bytes) -> list[bytes]:
        """The merge rules themselves, on the few bytes of a pair of tokens."""
        parts = [data[k : k + 1] for k in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: rank(parts[k] + parts[k + 1], _NO_RANK))
            if rank(parts[best] + parts[best + 1], _NO_RANK) == _NO_RANK:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pair_memo.get(key)
        if known is None:
            if len(self.pair_memo) > 400_000:
                self.pair_memo.clear()
            a, b = self.table[left], self.table[right]
            known = self.pair_memo[key] = self._merged(a + b) == [a, b]
        return known

    def _stands_alone(self, token: int) -> bool:
        key = (token, -1)
        known = self.pair_memo.get(key)
        if known is None:
            known = self.pair_memo[key] = self._merged(self.table[token]) == [self.table[token]]
        return known

    def _shorter(self, token: int) -> int:
        """The longest vocabulary entry that is a proper prefix of ``token``, or -1."""
        found = self.shorter_memo.get(token)
        if found is None:
            t = self.table[token]
            found = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)
            self.shorter_memo[token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (i, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = i  # ends rise, so the last one kept is the longest
        dead = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token, size = 0, longest[0], len(piece)
        while at < size:
            while token >= 0:
                end = at + len(self.table[token])
                if not dead[end] and (self._compatible(out[-1], token) if out else self._stands_alone(token)):
                    break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary doesn't cover every byte")
                token = out.pop()
                at -= len(self.table[token])
                token = self._shorter(token)
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        cache, parts = self.cache, []
        pieces = self.find(text)
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            pass
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = np.array(self.encode_piece(p.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(p) <= 64:
                    if len(cache) >= self.cache_limit:
                        cache.clear()
                    cache[p] = ids
            parts.append(ids)
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_LOADED: dict[tuple[str, str], BacktrackingBpe] = {}


def loaded(path: str, pattern: str) -> BacktrackingBpe:
    """One encoder for each vocabulary and Python worker."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = BacktrackingBpe(load_ranks(path), pattern)
    return _LOADED[key]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>) to every row; a null text counts as empty.

    Other columns pass through; a column named as ``ids`` is replaced.
    ``path`` must be readable on every executor.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, IntegerType

    def run(texts):
        import pandas as pd

        bpe = loaded(path, pattern)
        return pd.Series([bpe.encode(t or "") for t in texts])

    return df.withColumn(ids, F.pandas_udf(run, ArrayType(IntegerType(), False))(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary), the bytes of the ids; null ids give no bytes."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType

    def run(column):
        import pandas as pd

        bpe = loaded(path, pattern)
        return pd.Series([bpe.decode([] if x is None else list(x)) for x in column])

    return df.withColumn(out, F.pandas_udf(run, BinaryType())(F.col(ids)))


def encode_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of every document.

    The decoded bytes are rebuilt from the ids, not taken from the text. Null and
    empty texts have no tokens and the digests of no bytes; repeated rows give
    repeated results; other columns are not read.
    """

    def run(cols):
        bpe = loaded(path, pattern)
        n, ids_hex, out_hex, size = [], [], [], []
        for t in cols["text"].to_pylist():
            data = bpe.encode_bytes(t) if t else b""
            back = bpe.decode(np.frombuffer(data, "<u4").tolist())
            n.append(len(data) // 4)
            size.append(len(back))
            ids_hex.append(hashlib.sha256(data).hexdigest())
            out_hex.append(hashlib.sha256(back).hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids_hex, "decoded_sha256": out_hex, "n_bytes": size}

    return map_batches(
        df.select("doc_id", "text"),
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long",
    )
