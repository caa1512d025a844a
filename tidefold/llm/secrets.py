"""Secret scans: fixed patterns and a token-efficiency test for random strings.

Ordinary words are cheap under a subword vocabulary, random strings are not: a
string of few characters per token is reported as ``random`` unless it is a
known digest, a UUID or an identifier made of plain words and numbers.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, map_same

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Text that a Python worker takes at a time.
TEXT_BYTES = 8_000_000
#: The method's own parameters.
MIN_RANDOM, MAX_RATIO = 16, 2.2
#: Separators that belong to no secret at the ends of a run.
EDGES = "-/_+"
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_WIDE = np.zeros(256, bool)
_WIDE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-")] = True
_DIGEST = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_PARTS = re.compile(r"[+/_=-]+")
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})\Z")
_CAMEL = re.compile(r"[A-Z]?[a-z]{3,}(?:[A-Z][a-z]{2,})+[0-9]{0,3}\Z")

_ENCODERS: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    import tiktoken

    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding(
            "secret-scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path, pattern]


def _runs(data: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of member bytes of ``least`` or more."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def known_string(s: str) -> bool:
    """Digests of the usual lengths, UUIDs, and identifiers of words and short numbers."""
    if len(s) in DIGEST_CHARS and _DIGEST.match(s) or _UUID.match(s) or _CAMEL.match(s):
        return True
    parts = [p for p in _PARTS.split(s) if p]
    return all(_PLAIN.match(p) for p in parts)


def scan_batch(texts: list[str | None], encode) -> list[list[tuple[int, int, int]]]:
    """Per text, sorted (start, kind index, end) in code points, end exclusive."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)  # a line feed belongs to no class
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def place(starts, ends, kind, keep):
        docs = np.searchsorted(begin, starts, "right") - 1
        last, points = -1, None
        for s, e, d in zip(starts.tolist(), ends.tolist(), docs.tolist()):
            a, b = s - int(begin[d]), e - int(begin[d])
            if keep and not keep(raw[d][a:b].decode("ascii")):
                continue
            if d != last:
                last = d
                points = None if len(raw[d]) == len(texts[d]) else np.cumsum(
                    (np.frombuffer(raw[d], np.uint8) & 0xC0) != 0x80
                )
            # The class is ASCII, so each byte of the run is one code point.
            first = a if points is None else int(points[a]) - 1
            out[d].append((first, kind, first + b - a))

    place(*_runs(data, _HEX, MIN_HEX), 2, None)

    def is_random(s: str) -> bool:
        s = s.strip(EDGES)
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s) or (
            any(c.islower() for c in s) and any(c.isupper() for c in s[1:])
        )
        return len(s) >= MIN_RANDOM and mixed and not known_string(s) and len(s) < MAX_RATIO * len(encode(s))

    place(*_runs(data, _WIDE, MIN_RANDOM), 3, is_random)
    for spans, t in zip(out, texts):
        if not t:
            continue
        if ":" in t or "=" in t:
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= MIN_ASSIGN]
        if "AKIA" in t:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= MIN_ACCESS]
        # The method only adds: what base spans cover whole, but for separators, is not listed again.
        base = []
        for a, b in sorted((s, e) for s, k, e in spans if k < 3):
            if base and a <= base[-1][1]:
                base[-1][1] = max(base[-1][1], b)
            else:
                base.append([a, b])

        def covered(s: int, e: int) -> bool:
            for at in range(max(bisect.bisect_right(base, [s]) - 1, 0), len(base)):
                a, b = base[at]
                if a >= e:
                    break
                if t[s:a].strip(EDGES):
                    return False
                s = max(s, b)
            return not t[s:e].strip(EDGES)

        spans[:] = sorted(x for x in spans if x[1] < 3 or not covered(x[0], x[2]))
    return out


def scan(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row.

    Base spans are never dropped for a span of the method. Null and empty texts
    have no spans; repeated rows give repeated results; other columns are not read.
    """

    def run(cols):
        found = scan_batch(cols["text"].to_pylist(), _encoder(path, pattern).encode_ordinary)
        n = [[sum(k == kind for _, k, _ in x) for x in found] for kind in range(4)]
        say = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in x] for x in found]
        base = [
            hashlib.sha256(",".join(y for y, z in zip(said, x) if z[1] < 3).encode()).hexdigest()
            for said, x in zip(say, found)
        ]
        return {"doc_id": cols["doc_id"], "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": base, "spans": [",".join(x) for x in say], "n_random": n[3]}

    return map_batches(
        df.select("doc_id", "text"),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long",
        TEXT_BYTES,
    )


def redact(df: DataFrame, path: str, pattern: str, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``df``, each secret in ``text`` replaced by ``mask``.

    Overlapping spans become one mask. Texts without secrets, nulls included,
    stay as they are.
    """

    def run(piece):
        at = piece.schema.get_field_index("text")
        texts, out = piece.column(at).to_pylist(), []
        for t, spans in zip(texts, scan_batch(texts, _encoder(path, pattern).encode_ordinary)):
            parts, done, open_to = [], 0, -1
            for s, _, e in spans:
                if s >= open_to:
                    parts += [t[done:s], mask]
                done = open_to = max(open_to, e)
            out.append("".join([*parts, t[done:]]) if spans else t)
        return piece.set_column(at, piece.schema.field(at), pa.array(out, piece.schema.field(at).type))

    return map_same(df, run, TEXT_BYTES)
