"""Media columns: bytes kept in, and read back from, progressive JPEG files.

The format's unit is the quantised coefficient: one payload byte is one signed
coefficient, 64 bytes are one 8x8 block in zigzag order, and all quantisers are
1, so nothing is lost. Blocks fill the luma plane (2x2 sampling), then both
chroma planes.

Scans: DC without its lowest bit (interleaved), DC lowest bits; per component AC
1-5 and 6-63 without their lowest bit, then AC 1-63 lowest bits. Codes are
Huffman codes of many lengths, and a restart marker every RESTART units makes
the pieces of a scan independent of one another.

``read_files`` takes progressive files of 8-bit samples with any Huffman tables,
scan scripts, restart intervals and whole-number sampling. It decodes all scans
of a batch of files that don't build on one another at once: every piece between
restart markers is a lane, and each step of a numpy loop takes one symbol in all
lanes, looked up by the next 16 bits. Correction bits of refinement scans don't steer the reader, so
they are only noted while symbols are read and applied together afterwards.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

_I = np.arange(8)
#: Zigzag order from its rule: by anti-diagonal, direction alternating.
ZIGZAG = np.array(
    sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else k % 8))
)
_BASIS_BITS = 13
_BASIS = np.rint(
    np.where(_I[:, None] == 0, math.sqrt(0.125), 0.5)
    * np.cos((2 * _I[None, :] + 1) * _I[:, None] * np.pi / 16)
    * 2**_BASIS_BITS
)
_TAG = b"tidefold"
#: Units (MCUs, in AC scans blocks) between restart markers.
RESTART = 8
#: Text that a Python worker takes at a time, and coefficients that it decodes at a time.
TEXT_BYTES, GROUP = 1_000_000, 1 << 22

Table = tuple[tuple[int, ...], tuple[int, ...]]
#: The format's usual DC table, as counts by length and symbols.
_DC: Table = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))


def _table(weight: dict[int, float]) -> Table:
    """Code lengths of -log2 of each symbol's share, a tenth of which is spread evenly."""
    total = sum(weight.values())
    bits = {s: math.ceil(-math.log2(0.9 * w / total + 0.1 / len(weight))) for s, w in weight.items()}
    order = sorted(weight, key=lambda s: (bits[s], s))
    return tuple(sum(b == n for b in bits.values()) for n in range(1, 17)), tuple(order)


_EOB = {r << 4: 2.0 ** -(r + 6) for r in range(15)} | {0xF0: 2.0**-9}
#: Runs are rare in text, and its bytes have 5 or 6 bits without their lowest.
_AC_FIRST = _table({r << 4 | s: 4.0 ** -(r + abs(s - 6)) for r in range(16) for s in range(1, 11)} | _EOB)
_AC_REFINE = _table({r << 4 | 1: 1.0 for r in range(16)} | {k: 16 * v for k, v in _EOB.items()})


@lru_cache(64)
def _codes(table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by symbol."""
    code, value, bits, at = 0, np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    for n, count in enumerate(table[0], 1):
        for s in table[1][at : at + count]:
            value[s], bits[s] = code, n
            code += 1
        at += count
        code <<= 1
    return value, bits


@lru_cache(64)
def _lookup(table: Table, dc: bool) -> np.ndarray:
    """The next 16 bits -> symbol, bits of its code << 8, extra bits that follow << 16 and, for
    an end of band, 1 << 24; 0 where no code fits.
    """
    value, bits = _codes(table)
    out = np.zeros(1 << 16, np.int64)
    for s in table[1]:
        n = int(bits[s])
        first = int(value[s]) << (16 - n)
        ends = not dc and s & 15 == 0 and s >> 4 < 15
        extra = s & 15 if not ends else s >> 4
        out[first : first + (1 << (16 - n))] = ends << 24 | extra << 16 | n << 8 | s
    return out


# Writing.


def _packed(code: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> list[bytes]:
    """Entropy-coded bytes of each lane: codes of up to 32 bits in order, padded with ones, a zero after each 0xFF."""
    total = np.bincount(lane, bits, lanes).astype(np.int64)
    size = -(-total // 8)
    first = np.cumsum(size) - size
    before = np.cumsum(bits) - bits
    lead = np.cumsum(total) - total
    at = before + (first * 8 - lead)[lane]
    pad = 8 * size - total
    code = np.concatenate([code, (1 << pad) - 1]).astype(np.uint64)
    at = np.concatenate([at, first * 8 + total])
    shift = (64 - (at & 31) - np.concatenate([bits, pad])).astype(np.uint64) & np.uint64(63)
    frame = code << shift
    words = int(size.sum()) // 4 + 3
    word = at >> 5
    # Codes don't overlap, so their sum is their union; doubles hold such sums exactly.
    acc = np.bincount(word, (frame >> np.uint64(32)).astype(np.float64), words)
    acc += np.bincount(word + 1, (frame & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    data = acc.astype(np.uint32).astype(">u4").tobytes()
    return [data[a : a + n].replace(b"\xff", b"\xff\x00") for a, n in zip(first.tolist(), size.tolist())]


def _value_bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, size) of signed values as JPEG writes them."""
    size = np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)
    return np.where(v >= 0, v, v + (1 << size) - 1), size


def _with_extra(table: Table, symbol: np.ndarray, extra: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, bits = _codes(table)
    return value[symbol] << size | extra, bits[symbol] + size


def _ac_items(new: np.ndarray, hist: np.ndarray | None, extra: np.ndarray, size: np.ndarray, lane: np.ndarray):
    """(place, symbol, extra bits, their number, row) of the symbols of an AC scan, unordered.

    ``new`` (rows x width): coefficients to write, with the bits and sizes in ``extra`` and
    ``size``, in row-major order. ``hist``: coefficients that are not zero
    already and don't count in runs. A symbol's place is that of the first coefficient
    that it reaches from.
    """
    rows, width = new.shape
    flat = np.flatnonzero(new)
    row, col = np.divmod(flat, width)
    if hist is None:
        zeros, zero_at = col, None
    else:
        free = ~hist
        count = np.cumsum(free.reshape(-1)) - free.reshape(-1)
        zero_at = np.flatnonzero(free)
        row_zero = count[::width] if rows else count
        zeros = count[flat] - row_zero[row]
    follows = np.append(False, row[1:] == row[:-1])[: len(row)]
    since = np.where(follows, np.roll(zeros, 1) + 1, 0)
    begin = np.where(follows, np.roll(flat, 1) + 1, row * width)
    run = zeros - since
    longs = run >> 4

    def after(k, n):
        """Place after the n-th 16 free places from the start of symbol k on."""
        if zero_at is None:
            return begin[k] + 16 * n
        return np.where(n > 0, zero_at[np.minimum(row_zero[row[k]] + since[k] + 16 * n - 1, len(zero_at) - 1)] + 1, begin[k])

    every = np.arange(len(flat))
    skip = np.repeat(every, longs)
    nth = np.arange(len(skip)) - np.repeat(np.cumsum(longs) - longs, longs)
    # End-of-band runs: rows with places left, and empty rows after such a row of the same lane.
    last = np.full(rows, -1)
    last[row] = col
    open_ = last < width - 1
    joins = (last < 0) & np.append(False, open_[:-1] & (lane[1:] == lane[:-1]))[:rows]
    head = np.flatnonzero(open_ & ~joins)
    upto = np.append(head[1:], rows)
    runs = np.add.reduceat((open_ & (joins | np.isin(np.arange(rows), head))).astype(np.int64), head) if len(head) else upto[:0]
    power = np.frexp(runs.astype(np.float64))[1] - 1 if len(head) else runs
    return (
        np.concatenate([after(every, longs), after(skip, nth), head * width + last[head] + 1]),
        np.concatenate([(run & 15) << 4 | (size if hist is None else 1), np.full(len(skip), 0xF0), power << 4]),
        np.concatenate([extra, np.zeros(len(skip), np.int64), runs - (1 << power)]),
        np.concatenate([size, np.zeros(len(skip), np.int64), power]),
        np.concatenate([row, row[skip], head]),
    )


def _ac_scan(band: np.ndarray, al: int, first: bool, lane: np.ndarray, lanes: int) -> list[bytes]:
    """Lanes of an AC scan of ``band`` (rows x width, whole coefficients)."""
    mag = np.abs(band) >> al
    if first:
        new = mag > 0
        extra, size = _value_bits(np.where(band < 0, -mag, mag)[new].astype(np.int64))
        at, symbol, extra, size, row = _ac_items(new, None, extra, size, lane)
        code, bits = _with_extra(_AC_FIRST, symbol, extra, size)
        order = np.argsort(at, kind="stable")
        return _packed(code[order], bits[order], lane[row[order]], lanes)
    hist, new = mag > 1, mag == 1
    n = int(new.sum())
    at, symbol, extra, size, row = _ac_items(new, hist, (band[new] > 0).astype(np.int64), np.ones(n, np.int64), lane)
    code, bits = _with_extra(_AC_REFINE, symbol, extra, size)
    # Correction bits: of rows that are full already 32 at a time, else one by one.
    width = band.shape[1]
    low = (mag & 1).astype(np.uint8)
    full = np.flatnonzero(hist.all(1)) if width == 63 else np.empty(0, np.int64)
    eight = np.packbits(low[full], axis=1).reshape(-1, 8).view(">u4").astype(np.int64)
    hist[full] = False
    fix = np.flatnonzero(hist)
    at = np.concatenate([2 * at, 2 * fix + 1, 2 * full * width + 1, 2 * (full * width + 32) + 1])
    order = np.argsort(at, kind="stable")
    code = np.concatenate([code, low.reshape(-1)[fix], eight[:, 0], eight[:, 1] >> 1])[order]
    bits = np.concatenate([bits, np.ones(len(fix), np.int64), np.full(len(full), 32), np.full(len(full), 31)])[order]
    return _packed(code, bits, lane[np.concatenate([row, fix // width, full, full])[order]], lanes)


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _sos(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _marker(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([ss, se, ah << 4 | al]))


def _grid(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks of 64 bytes, 6 to an MCU."""
    mcus = -(-blocks // 6)
    across = max(1, min(4095, math.isqrt(mcus)))
    down = -(-mcus // across)
    if down > 4095:
        raise ValueError("too long for one image")
    return across, down


@lru_cache(256)
def _mcu_order(across: int, down: int) -> np.ndarray:
    """Rows of the blocks of a 4:2:0 file, luma and both chroma planes after one another, by MCU."""
    x, y = np.meshgrid(np.arange(across), np.arange(down))
    first = (2 * y * 2 * across + 2 * x).reshape(-1, 1)
    mcu = np.arange(across * down)[:, None]
    return np.hstack([first + np.array([0, 1, 2 * across, 2 * across + 1]), 4 * len(mcu) + mcu, 5 * len(mcu) + mcu])


def _lanes(counts: list[int]) -> tuple[np.ndarray, list[int]]:
    """(lane of each of the units of all files, number of lanes of each file)."""
    each = [-(-n // RESTART) for n in counts]
    first = np.cumsum([0, *each[:-1]])
    return np.concatenate([a + np.arange(n) // RESTART for a, n in zip(first, counts)]), each


def _split(lanes: list[bytes], each: list[int]) -> list[bytes]:
    """The entropy-coded data of each file, with restart markers."""
    out, at = [], 0
    for n in each:
        parts = [lanes[at]]
        for k in range(1, n):
            parts += [bytes([0xFF, 0xD0 + (k - 1) % 8]), lanes[at + k]]
        out.append(b"".join(parts))
        at += n
    return out


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload (a positive multiple of 64 bytes)."""
    if not payloads:
        return []
    grids = [_grid(len(p) // 64) for p in payloads]
    mcus = [a * d for a, d in grids]
    base = np.cumsum([0, *(6 * m for m in mcus)])
    coef = np.zeros((int(base[-1]), 64), np.int8)
    for p, b in zip(payloads, base.tolist()):
        coef[b : b + len(p) // 64] = np.frombuffer(p, np.int8).reshape(-1, 64)
    files = [
        [
            b"\xff\xd8",
            _marker(0xFE, _TAG + struct.pack(">Q", len(p))),
            _marker(0xDB, b"\x00" + b"\x01" * 64),
            _marker(0xC2, struct.pack(">BHHB", 8, 16 * d, 16 * a, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
            *(_marker(0xC4, bytes([slot, *t[0], *t[1]])) for slot, t in ((0x00, _DC), (0x10, _AC_FIRST), (0x11, _AC_REFINE))),
            _marker(0xDD, struct.pack(">H", RESTART)),
        ]
        for p, (a, d) in zip(payloads, grids)
    ]

    def add(head: bytes, lanes: list[bytes], each: list[int]) -> None:
        for f, data in zip(files, _split(lanes, each)):
            f += [head, data]

    parts = [(1, 0), (2, 0), (3, 0)]
    lane, each = _lanes(mcus)
    order = np.concatenate([b + _mcu_order(*g) for b, g in zip(base.tolist(), grids)])
    dc = coef[:, 0][order].astype(np.int64)
    high, fresh = dc >> 1, np.append(True, lane[1:] != lane[:-1])
    line = np.concatenate([np.zeros((len(dc), 1), np.int64), high[:, :3]], 1)
    line[1:, 0] = high[:-1, 3]
    last = np.concatenate([line, np.roll(high[:, 4:], 1, 0)], 1)
    last[np.ix_(fresh, [0, 4, 5])] = 0
    extra, size = _value_bits((high - last).reshape(-1))
    code, bits = _with_extra(_DC, size, extra, size)
    by_unit = np.repeat(lane, 6)
    add(_sos(parts, 0, 0, 0, 1), _packed(code, bits, by_unit, sum(each)), each)
    add(_sos(parts, 0, 0, 1, 0), _packed((dc & 1).reshape(-1), np.ones(dc.size, np.int64), by_unit, sum(each)), each)
    for c in (0, 1, 2):
        counts = [m * (4 if c == 0 else 1) for m in mcus]
        skip = [0 if c == 0 else m * (3 + c) for m in mcus]
        plane = coef[np.concatenate([np.arange(b + s, b + s + n) for b, s, n in zip(base.tolist(), skip, counts)])].astype(np.int16)
        lane, each = _lanes(counts)
        for ss, se, ah, al, t in ((1, 5, 0, 1, 0), (6, 63, 0, 1, 0), (1, 63, 1, 0, 1)):
            add(_sos([(c + 1, t)], ss, se, ah, al), _ac_scan(plane[:, ss : se + 1], al, not ah, lane, sum(each)), each)
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG file that holds ``payload`` (a positive multiple of 64 bytes)."""
    return encode_payloads([payload])[0]


# Reading.

_END = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def _parsed(data: bytes) -> dict:
    """Header values, components and scans of a file; nothing is decoded."""
    info, quant, huff, every = {"payload": None, "components": [], "scans": []}, {}, {}, 0
    comps, at = info["components"], 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 2 or data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        code = data[at + 1]
        if code == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xFE and body.startswith(_TAG) and len(body) == len(_TAG) + 8:
            info["payload"] = struct.unpack(">Q", body[len(_TAG) :])[0]
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                quant[body[0] & 15], body = values, body[65 + 64 * wide :]
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]], body = (tuple(body[1:17]), tuple(body[17 : 17 + n])), body[17 + n :]
        elif code == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif code == 0xC2:
            bits, info["height"], info["width"], n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3) or not info["height"]:
                raise ValueError("only files of 8-bit samples, 1 or 3 components and a stated height")
            specs = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hmax, vmax = max(s[1] for s in specs), max(s[2] for s in specs)
            if any(hmax % h or vmax % v for _, h, v, _ in specs):
                raise ValueError("only sampling factors that divide the largest")
            info |= {"hmax": hmax, "vmax": vmax, "mcus": (-(-info["width"] // (8 * hmax)), -(-info["height"] // (8 * vmax)))}
            for i, h, v, q in specs:
                own = (-(-info["width"] * h // (8 * hmax)), -(-info["height"] * v // (8 * vmax)))
                comps.append({"id": i, "h": h, "v": v, "quant": q, "across": info["mcus"][0] * h, "down": info["mcus"][1] * v, "own": own})
        elif code == 0xDA:
            parts = [(next(c for c in comps if c["id"] == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            ss, se, a = body[-3:]
            found = _END.search(data, at)
            if not found:
                raise ValueError("no marker after a scan")
            tables = [huff.get(t >> 4 if ss == 0 else 0x10 | t & 15) for _, t in parts]
            pieces = _RST.split(data[at : found.start()]) if every else [data[at : found.start()]]
            info["scans"].append((parts, tables, ss, se, a >> 4, a & 15, every, pieces))
            at = found.start()
        elif 0xC0 <= code <= 0xCF and code != 0xCC:
            raise ValueError("not a progressive file of Huffman codes")
    if not comps:
        raise ValueError("no frame")
    for c in comps:
        c["q"] = quant[c["quant"]]
    return info


def _order(parts, mcus) -> np.ndarray:
    """Rows of the blocks of a scan, as (MCU, block in the MCU)."""
    base = parts[0][0]["row"]
    shape = (mcus, tuple((c["row"] - base, c["across"], c["h"], c["v"], c["own"]) for c, _ in parts))
    return base + (_small_order if mcus[0] * mcus[1] < 1000 else _any_order)(*shape)


def _any_order(mcus: tuple[int, int], parts: tuple) -> np.ndarray:
    if len(parts) == 1:
        _, across, _, _, own = parts[0]
        return (np.arange(own[1])[:, None] * across + np.arange(own[0])).reshape(-1, 1)
    x, y = np.meshgrid(np.arange(mcus[0]), np.arange(mcus[1]))
    return np.hstack(
        [
            row + (y * v * across + x * h).reshape(-1, 1) + (np.arange(v)[:, None] * across + np.arange(h)).reshape(-1)
            for row, across, h, v, _ in parts
        ]
    )


_small_order = lru_cache(1024)(_any_order)


class _Lanes:
    """The pieces of one scan of some files: a row of bytes each, and the rows of their blocks.

    ``at`` and ``end`` are bit positions in the joined bytes, ``first`` and
    ``count`` the place and number of a lane's blocks in ``order``.
    """

    def __init__(self, pieces: list[bytes], orders: list[np.ndarray], tables: list[int], luts: np.ndarray):
        data = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
        size = np.array([len(d) for d in data], np.int64)
        self.raw = np.frombuffer(b"".join([*data, bytes(8)]), np.uint8)
        raw = self.raw.astype(np.uint32)
        self.window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        self.end = np.cumsum(size) * 8
        self.at = self.end - 8 * size
        self.count = np.array([o.size for o in orders], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.order = np.concatenate([o.reshape(-1) for o in orders])
        self.tables, self.luts = np.array(tables, np.int64), luts
        self.wide = bool(((luts >> 8 & 255) + (luts >> 16 & 15)).max() > 25)

    def bit(self, at: np.ndarray) -> np.ndarray:
        """The bit at each place, uint8."""
        return self.raw.take(at >> 3, mode="clip") >> (~at & 7).astype(np.uint8) & 1

    def symbol(self, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(what ``_lookup`` says, extra bits, place after them)."""
        skip = at & 7
        window = self.window.take(at >> 3, mode="clip").astype(np.int64)
        found = self.luts.take(table + (window >> (16 - skip) & 0xFFFF))
        code, extra = found >> 8 & 255, found >> 16 & 15
        used = skip + code + extra
        bits = window >> np.maximum(32 - used, 0) & ((1 << extra) - 1)
        if self.wide:  # a code and its extra bits may not fit the window
            far = np.flatnonzero(used > 32)
            start = (at + code)[far]
            again = self.window.take(start >> 3, mode="clip").astype(np.int64)
            bits[far] = again >> (32 - (start & 7) - extra[far]) & ((1 << extra[far]) - 1)
        return found, bits, at + code + extra

    def check(self, at: np.ndarray, lanes: np.ndarray) -> None:
        if (at > self.end[lanes]).any():
            raise ValueError("a scan ends too early")


def _dc_first(x: _Lanes, coef: np.ndarray, units: np.ndarray, tables: np.ndarray, comps: np.ndarray, al: int) -> None:
    """``units``: blocks of an MCU; ``tables`` and ``comps``: per lane, those of each of them."""
    live, at, k = np.arange(len(x.at)), x.at.copy(), np.zeros(len(x.at), np.int64)
    last = np.zeros((len(x.at), 4), np.int64)
    while len(live):
        unit = k % units[live]
        found, bits, at = x.symbol(at, tables[live, unit])
        if not found.all():
            raise ValueError("no such code")
        size = found >> 16 & 15
        value = bits - ((1 << size) - 1) * (bits < (1 << size) >> 1)
        comp = comps[live, unit]
        last[live, comp] += value
        coef[x.order[x.first[live] + k], 0] = last[live, comp] << al
        k = k + 1
        go = k < x.count[live]
        if not go.all():
            x.check(at[~go], live[~go])
            live, at, k = live[go], at[go], k[go]


def _dc_refine(x: _Lanes, coef: np.ndarray, al: int) -> None:
    x.check(x.at + x.count, np.arange(len(x.at)))
    at = np.repeat(x.at - x.first, x.count) + np.arange(len(x.order))
    coef[x.order, 0] |= x.bit(at).astype(coef.dtype) << al


def _ac_first(x: _Lanes, coef: np.ndarray, ss: np.ndarray, se: np.ndarray, al: int) -> None:
    """``ss`` and ``se``: first and last coefficient of each lane. The last two rows of ``coef`` are
    written to by lanes that are done, which leave the loop some at a time, and are of no use.
    """
    flat, order, nowhere = coef.reshape(-1), np.append(x.order, len(coef) - 2), len(x.order)
    live, at = np.arange(len(x.at)), x.at.copy()
    block, k, table = x.first.copy(), ss.copy(), x.tables.copy()
    stop, base, gone = x.first + x.count, order[block] << 6, 0
    while len(live):
        found, bits, at = x.symbol(at, table)
        size, ends = found & 15, found >> 24 > 0
        k = k + (found >> 4 & 15)
        if not found.all() or (k > se).any():
            odd = (found == 0) | (k > se) & ~ends & (size > 0)
            if (odd & (block < nowhere)).any():
                raise ValueError("no such code, or a run leaves its band")
        value = bits - ((1 << size) - 1) * (bits < (1 << size) >> 1)
        flat[np.where(size > 0, base + k, len(flat) - 1)] = value << al
        k += 1
        over = ends | (k > se)
        if over.any():
            at_end = np.flatnonzero(over)
            step = np.where(ends[at_end], (1 << (found[at_end] >> 16 & 15)) + bits[at_end], 1)
            k[at_end] = ss[at_end]
            moved = block[at_end] + step
            block[at_end] = moved
            done = at_end[moved >= stop[at_end]]
            if len(done):
                fresh = done[stop[done] > 0]
                x.check(at[fresh], live[fresh])
                block[done], stop[done] = nowhere, 0
                gone += len(fresh)
            base[at_end] = order[block[at_end]] << 6
            if gone * 8 > len(live):
                go = stop > 0
                live, at, block, k, table, stop, base, ss, se = (v[go] for v in (live, at, block, k, table, stop, base, ss, se))
                gone = 0


def _ac_refine(x: _Lanes, coef: np.ndarray, ss: int, se: int, al: int) -> None:
    width = se - ss + 1
    band = coef[x.order, ss : se + 1]
    hist = (band != 0).reshape(-1)
    known = np.concatenate([[0], np.cumsum(hist)])  # coefficients not zero before each place
    free, full = np.flatnonzero(~hist), np.flatnonzero(hist)
    live, at, table = np.arange(len(x.at)), x.at.copy(), x.tables.copy()
    place, stop = x.first * width, (x.first + x.count) * width
    notes, fresh = [], []
    while len(live):
        found, bits, at = x.symbol(at, table)
        if not found.all():
            raise ValueError("no such code")
        run, size, ends = found >> 4 & 15, found & 15, found >> 24 > 0
        # The run ends at the (run + 1)-th place from here that is zero, or with whole blocks.
        nth = place - known[place] + run
        goal = free[np.minimum(nth, len(free) - 1)] if len(free) else place
        edge = (place // width + 1) * width
        if ((goal >= edge) | (nth >= len(free)) | (size > 1))[~ends].any():
            raise ValueError("a run leaves its band")
        goal = np.where(ends, np.minimum(edge + ((1 << run) + bits - 1) * width, stop), goal)
        fix = known[goal] - known[place]
        some = np.flatnonzero(fix)
        notes.append((at[some], known[place[some]], fix[some]))
        put = np.flatnonzero(size)
        if len(put):
            fresh.append((goal[put], np.where(bits[put] > 0, 1, -1)))
        at = at + fix
        place = np.where(ends, goal, goal + 1)
        go = place < stop
        if not go.all():
            x.check(at[~go], live[~go])
            live, at, table, place, stop = live[go], at[go], table[go], place[go], stop[go]
    flat, step = band.reshape(-1), 1 << al
    first, which, many = (np.concatenate(c) for c in zip(*notes)) if notes else (np.empty(0, np.int64),) * 3
    lead = np.cumsum(many) - many
    at = np.repeat(first - lead, many) + np.arange(int(many.sum()))
    where = full[np.repeat(which - lead, many) + np.arange(int(many.sum()))]
    old = flat[where]
    fix = x.bit(at).astype(flat.dtype) * (np.abs(old) & step == 0)
    flat[where] = old + np.where(old > 0, fix, -fix) * step
    for goal, sign in fresh:
        flat[goal] = sign * step
    coef[x.order, ss : se + 1] = band


def _decode(kind: tuple, jobs: list, coef: np.ndarray) -> None:
    """Decode the lanes of scans of one kind: (dc, refinement, al, band of an AC refinement)."""
    dc, refine, al, band = kind
    names: dict = {}
    pieces, orders, tables, unit_tables, unit_comps, units, bands = [], [], [], [], [], [], []
    for parts, own, every, data, mcus, *span in jobs:
        if not (dc and refine):
            for t in own:
                if t is None:
                    raise ValueError("a scan without its table")
                names.setdefault(t, len(names) << 16)
        order = _order(parts, mcus)
        step = every or len(order)
        if len(data) != -(-len(order) // step):
            raise ValueError("restart markers are missing")
        pieces += data
        orders += [order[a : a + step] for a in range(0, len(order), step)]
        tables += [names.get(own[0], 0)] * len(data)
        bands += [span] * len(data)
        if dc and not refine:
            each = [1] if len(parts) == 1 else [c["h"] * c["v"] for c, _ in parts]
            row = [names[t] for t, n in zip(own, each) for _ in range(n)]
            comp = [k for k, n in enumerate(each) for _ in range(n)]
            pad = [0] * (12 - len(row))
            unit_tables += [row + pad] * len(data)
            unit_comps += [comp + pad] * len(data)
            units += [len(row)] * len(data)
    luts = np.concatenate([_lookup(t, dc) for t in names]) if names else np.zeros(1, np.int64)
    a = 0
    while a < len(pieces):  # some lanes at a time
        b, held = a, 0
        while b < len(pieces) and (b == a or held + 64 * orders[b].size <= GROUP):
            held += 64 * orders[b].size
            b += 1
        x = _Lanes(pieces[a:b], orders[a:b], tables[a:b], luts)
        if dc and refine:
            _dc_refine(x, coef, al)
        elif dc:
            _dc_first(x, coef, np.array(units[a:b]), np.array(unit_tables[a:b]), np.array(unit_comps[a:b]), al)
        elif refine:
            _ac_refine(x, coef, *band, al)
        else:
            _ac_first(x, coef, *np.array(bands[a:b]).T, al)
        a = b


def read_files(files: list[bytes]) -> list[dict]:
    """Per file height, width, payload size (None if not ours) and per component: coefficients
    (blocks x 64, zigzag, raster order), blocks across, sampling, quantisers.
    """
    infos, rows = [_parsed(f) for f in files], 0
    for info in infos:
        info["row"] = rows
        for c in info["components"]:
            c["row"] = rows
            rows += c["across"] * c["down"]
        info["rows"] = rows - info["row"]
    coef = np.zeros((rows + 2, 64), np.int16)
    turns: list[dict] = []
    for info in infos:
        done: list[tuple] = []  # (component, ss, se, turn) of the scans so far
        for parts, tables, ss, se, ah, al, every, pieces in info["scans"]:
            own = [c["id"] for c, _ in parts]
            turn = 1 + max((t for i, a, b, t in done if i in own and a <= se and ss <= b), default=-1)
            done += [(i, ss, se, turn) for i in own]
            while len(turns) <= turn:
                turns.append({})
            kind = (ss == 0, ah > 0, al, (ss, se) if ss and ah else None)
            turns[turn].setdefault(kind, []).append((parts, tables, every, pieces, info["mcus"], ss, se))
    for kinds in turns:
        for kind, jobs in kinds.items():
            _decode(kind, jobs, coef)
    for info in infos:
        del info["scans"]
        info["coef"] = coef[info["row"] : info["row"] + info["rows"]]
        for c in info["components"]:
            c["coef"] = coef[c["row"] : c["row"] + c["across"] * c["down"]]
    return infos


def read_coefficients(data: bytes) -> dict:
    """``read_files`` of one file."""
    return read_files([data])[0]


def payload_of(read: dict) -> bytes:
    """The payload bytes of a file written by ``encode_payload``."""
    return read["coef"][: read["payload"] // 64].astype(np.int8).tobytes()


def _samples(coef: np.ndarray, q: np.ndarray) -> np.ndarray:
    """8x8 samples of blocks, uint8.

    The transform multiplies whole numbers held in doubles, so every sum is exact
    and the samples are the same on every machine.
    """
    n = len(coef)
    block = np.empty((n, 64))
    block[:, ZIGZAG] = coef * q
    half = (block.reshape(n * 8, 8) @ _BASIS).reshape(n, 8, 8)
    full = (half.transpose(0, 2, 1).reshape(n * 8, 8) @ _BASIS).reshape(n, 8, 8).transpose(0, 2, 1)
    full *= 2.0 ** (-2 * _BASIS_BITS)
    return np.clip(np.floor(full + 128.5), 0, 255).astype(np.uint8)


def rgb_tensor(read: dict) -> np.ndarray:
    """Full-resolution RGB samples, height x width x 3, uint8; some rows of MCUs at a time."""
    out = np.empty((read["mcus"][1] * 8 * read["vmax"], read["mcus"][0] * 8 * read["hmax"], 3), np.uint8)
    step = max(1, 16_384 // max(c["across"] * c["v"] for c in read["components"]))
    for top in range(0, read["mcus"][1], step):
        down = min(step, read["mcus"][1] - top)
        planes = []
        for c in read["components"]:
            wide, high = c["across"], down * c["v"]
            at = top * c["v"] * wide
            samples = _samples(c["coef"][at : at + high * wide], c["q"]).reshape(high, wide, 8, 8)
            plane = samples.transpose(0, 2, 1, 3).reshape(high * 8, wide * 8).astype(np.int32)
            planes.append(plane.repeat(read["vmax"] // c["v"], 0).repeat(read["hmax"] // c["h"], 1))
        part = out[top * 8 * read["vmax"] : (top + down) * 8 * read["vmax"]]
        if len(planes) == 1:
            part[:] = planes[0][:, :, None]
            continue
        y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
        # 16-bit fixed point of 1.402, 0.344136, 0.714136 and 1.772.
        half = 1 << 15
        part[:, :, 0] = np.clip((y + 91881 * cr + half) >> 16, 0, 255)
        part[:, :, 1] = np.clip((y - 22554 * cb - 46802 * cr + half) >> 16, 0, 255)
        part[:, :, 2] = np.clip((y + 116130 * cb + half) >> 16, 0, 255)
    return out[: read["height"], : read["width"]]


def to_payload(text: str | None) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return len(raw), raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def feature(rgb: np.ndarray) -> str:
    """Shape, mean of each channel in thousandths, and a checksum of the tensor."""
    means = [int(rgb[:, :, k].sum(dtype=np.int64)) * 1000 // (rgb.shape[0] * rgb.shape[1]) for k in range(3)]
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def store(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary), the progressive JPEG of each text's bytes.

    Null and empty texts are 64 zero bytes; repeated rows give repeated results;
    an empty table gives none. Other columns, whatever their names, are left
    out. A long text is one file, encoded by itself.
    """

    def run(cols):
        made = [to_payload(t) for t in cols["text"].to_pylist()]
        return {"doc_id": cols["doc_id"], "n_bytes": [n for n, _ in made], "media": encode_payloads([p for _, p in made])}

    return map_batches(df.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary", TEXT_BYTES)


def decode(media: DataFrame) -> DataFrame:
    """The columns doc_id, n_bytes and media with payload (binary, null if the file isn't
    of ``store``), height, width and rgb, the row-major uint8 tensor.

    A null or empty file has a null payload and an empty tensor.
    """

    def run(cols):
        files = cols["media"].to_pylist()
        reads = read_files([m for m in files if m])
        out = {"payload": [], "height": [], "width": [], "rgb": []}
        there = iter(reads)
        for m in files:
            read = next(there) if m else None
            rgb = rgb_tensor(read) if m else np.zeros((0, 0, 3), np.uint8)
            out["payload"].append(payload_of(read) if m and read["payload"] is not None else None)
            out["height"].append(rgb.shape[0])
            out["width"].append(rgb.shape[1])
            out["rgb"].append(rgb.tobytes())
        return {k: cols[k] for k in ("doc_id", "n_bytes", "media")} | out

    return map_batches(
        media.select("doc_id", "n_bytes", "media"),
        run,
        "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary",
        TEXT_BYTES,
        "media",
    )


def digests(decoded: DataFrame) -> DataFrame:
    """The registered query's columns, from those of ``decode`` on files of ``store``."""

    def run(cols):
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for m, payload, high, wide, rgb in zip(*(cols[k].to_pylist() for k in ("media", "payload", "height", "width", "rgb"))):
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(m))
            out["media_sha256"].append(hashlib.sha256(m).hexdigest())
            out["feature"].append(feature(np.frombuffer(rgb, np.uint8).reshape(high, wide, 3)))
        return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]} | out

    return map_batches(
        decoded,
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
        TEXT_BYTES,
        "rgb",
    )
