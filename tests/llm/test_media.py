import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest

from tidefold.llm import media as M


class Bits:
    """Reads and writes bits one at a time."""

    def __init__(self, data=b""):
        self.bits, self.at = [b >> k & 1 for b in data for k in range(7, -1, -1)], 0

    def take(self, n):
        self.at += n
        return int("0" + "".join(map(str, self.bits[self.at - n : self.at])), 2)

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def data(self):
        own = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, own[k : k + 8])), 2) for k in range(0, len(own), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def codes(table):
    out, code, at = {}, 0, 0
    for n, count in enumerate(table[0], 1):
        for s in table[1][at : at + count]:
            out[s] = (code, n)
            code += 1
        at += count
        code <<= 1
    return out


def plain_pieces(comps, parts, mcus, every):
    """Blocks of a scan as (component number in the scan, row), by restart interval."""
    if len(parts) == 1:
        c = comps[parts[0]]
        units = [[(0, y * c["across"] + x)] for y in range(c["own"][1]) for x in range(c["own"][0])]
    else:
        units = [
            [(k, (my * comps[i]["v"] + y) * comps[i]["across"] + mx * comps[i]["h"] + x) for k, i in enumerate(parts) for y in range(comps[i]["v"]) for x in range(comps[i]["h"])]
            for my in range(mcus[1])
            for mx in range(mcus[0])
        ]
    step = every or len(units)
    return [[b for u in units[k : k + step] for b in u] for k in range(0, len(units), step)]


def plain_read(data):
    """Coefficients of a file, bit by bit as the standard has it."""
    info = M._parsed(data)
    comps = info["components"]
    for c in comps:
        c["coef"] = np.zeros((c["across"] * c["down"], 64), int)
    for parts, tables, ss, se, ah, al, every, pieces in info["scans"]:
        back = [{v: k for k, v in codes(t).items()} if t else {} for t in tables]
        own = [c["coef"] for c, _ in parts]
        where = plain_pieces(comps, [next(k for k, c in enumerate(comps) if c is p) for p, _ in parts], info["mcus"], every)
        assert len(where) == len(pieces)
        for piece, blocks in zip(pieces, where):
            bits, last, run = Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * len(parts), 0

            def symbol(table):
                code = 0
                for n in range(1, 17):
                    code = code << 1 | bits.take(1)
                    if (code, n) in table:
                        return table[code, n]

            def signed(n):
                v = bits.take(n)
                return v if not n or v >> (n - 1) else v - (1 << n) + 1

            def correct(row, k):
                if bits.take(1) and not abs(row[k]) >> al & 1:
                    row[k] += (1 << al) if row[k] > 0 else -(1 << al)

            for c, b in blocks:
                row = own[c][b]
                if ss == 0:
                    if ah:
                        row[0] |= bits.take(1) << al
                    else:
                        last[c] += signed(symbol(back[c]))
                        row[0] = last[c] << al
                    continue
                k = ss
                while k <= se and not run:
                    s = symbol(back[0])
                    r, size = s >> 4, s & 15
                    if not size and r < 15:
                        run = (1 << r) + bits.take(r)
                        break
                    value = signed(size) * (1 << al)
                    if not ah:
                        k += r
                        row[k] = value
                    else:
                        while row[k] or r:
                            if row[k]:
                                correct(row, k)
                            else:
                                r -= 1
                            k += 1
                        if size:
                            row[k] = value
                    k += 1
                if run:
                    for k in range(k, se + 1) if ah else ():
                        if row[k]:
                            correct(row, k)
                    run -= 1
    return comps


def plain_write(width, height, sampling, planes, script, every):
    """A progressive file by the standard's procedures, bit by bit, with tables of its own."""
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    mcus = (-(-width // (8 * hmax)), -(-height // (8 * vmax)))
    comps = [
        {"h": h, "v": v, "across": mcus[0] * h, "down": mcus[1] * v, "own": (-(-width * h // (8 * hmax)), -(-height * v // (8 * vmax)))}
        for h, v in sampling
    ]
    need = [s for s in range(256) if s & 15 <= 10 or s < 12]
    table = ((0, 0, 1, 1) + (0,) * 3 + (150, len(need) - 152) + (0,) * 7, tuple(sorted(need, key=lambda s: s * 37 % 251)))
    code = codes(table)
    out = [b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(range(1, 65))]
    out.append(b"\xff\xc2" + (8 + 3 * len(comps)).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(comps)]))
    out.append(b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    for slot in (0x00, 0x10):
        out.append(b"\xff\xc4" + (19 + len(need)).to_bytes(2, "big") + bytes([slot, *table[0], *table[1]]))
    if every:
        out.append(b"\xff\xdd\x00\x04" + every.to_bytes(2, "big"))
    for parts, ss, se, ah, al in script:
        out.append(b"\xff\xda" + (6 + 2 * len(parts)).to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in parts) + bytes([ss, se, ah << 4 | al]))
        pieces = []
        for blocks in plain_pieces(comps, parts, mcus, every):
            bits, last, run, held = Bits(), [0] * len(parts), 0, []

            def signed(v):
                n = abs(v).bit_length()
                bits.put(v if v >= 0 else v + (1 << n) - 1, n)

            def end_band():
                nonlocal run, held
                if run:
                    n = run.bit_length() - 1
                    bits.put(*code[n << 4])
                    bits.put(run - (1 << n), n)
                    bits.bits += held
                run, held = 0, []

            for c, b in blocks:
                row = [int(x) for x in planes[parts[c]][b]]
                if ss == 0:
                    if ah:
                        bits.put(row[0] >> al & 1, 1)
                    else:
                        diff = (row[0] >> al) - last[c]
                        last[c] += diff
                        bits.put(*code[abs(diff).bit_length()])
                        signed(diff)
                    continue
                mag = [abs(x) >> al for x in row]
                ends = max((k for k in range(ss, se + 1) if (mag[k] == 1 if ah else mag[k])), default=ss - 1)
                r, fixes = 0, []
                for k in range(ss, ends + 1):
                    if not mag[k]:
                        r += 1
                        continue
                    end_band()
                    while r > 15:
                        bits.put(*code[0xF0])
                        bits.bits += fixes
                        r, fixes = r - 16, []
                    if ah and mag[k] > 1:
                        fixes.append(mag[k] & 1)
                        continue
                    bits.put(*code[r << 4 | (1 if ah else mag[k].bit_length())])
                    if ah:
                        bits.put(int(row[k] > 0), 1)
                        bits.bits += fixes
                    else:
                        signed(mag[k] if row[k] > 0 else -mag[k])
                    r, fixes = 0, []
                if ends < se:
                    run += 1
                    held += [mag[k] & 1 for k in range(ends + 1, se + 1) if ah and mag[k]]
                    if run == 0x7FFF:
                        end_band()
            end_band()
            pieces.append(bits.data())
        out.append(pieces[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + x for k, x in enumerate(pieces[1:])))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 7, 24, 25, 60, 700])
def test_payload_round_trip(blocks):
    rng = random.Random(blocks)
    some = [bytes(64 * blocks), b"\xff" * 64 * blocks, rng.randbytes(64 * blocks)]
    some += [bytes(rng.choice(kinds) for _ in range(64 * blocks)) for kinds in ([0] * 5 + [1, 255, 2, 254], [0] * 60 + [1, 255, 5], [97, 98, 32, 1])]
    files = M.encode_payloads(some)
    for payload, data, read in zip(some, files, M.read_files(files)):
        assert M.payload_of(read) == payload and data == M.encode_payload(payload)
        if blocks <= 60:
            assert all((a["coef"] == b["coef"]).all() for a, b in zip(plain_read(data), read["components"]))


def test_file_is_a_progressive_jpeg_of_codes_of_many_lengths():
    data = M.encode_payload(bytes(range(256)) * 3)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    assert data.count(b"\xff\xc2") == 1 and data.count(b"\xff\xda") == 11
    for table in (M._DC, M._AC_FIRST, M._AC_REFINE):
        assert sum(n > 0 for n in table[0]) > 3
        assert sum(n / 2 ** (k + 1) for k, n in enumerate(table[0])) <= 1 - 2**-16  # no code of ones only


FULL = [((0, 1, 2), 0, 0, 0, 1), ((0, 1, 2), 0, 0, 1, 0)]
THREE = [*FULL, *(((c,), *a) for c in range(3) for a in ((1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)))]
ONE = [((0,), 0, 0, 0, 0), ((0,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0)]


@pytest.mark.parametrize("every", [0, 1, 3])
@pytest.mark.parametrize("sampling, script", [([(2, 2), (1, 1), (1, 1)], THREE), ([(1, 1)] * 3, THREE), ([(2, 1), (1, 1), (1, 1)], THREE), ([(1, 1)], ONE), ([(4, 2), (2, 1), (1, 2)], THREE)])
def test_files_of_another_writer(every, sampling, script):
    rng = random.Random(every + 7 * len(script) + sampling[0][0])
    made = []
    for width, height, share in ((40, 37, 0.1), (8, 8, 0.5), (65, 16, 0.02), (33, 50, 0.9)):
        hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
        n = [-(-width // (8 * hmax)) * h * -(-height // (8 * vmax)) * v for h, v in sampling]
        planes = [np.array([[rng.choice([1, -1, 2, -3, 5, 40, -300]) if rng.random() < share else 0 for _ in range(64)] for _ in range(k)]) for k in n]
        made.append(plain_write(width, height, sampling, planes, script, every))
    for data, read in zip(made, M.read_files(made)):
        assert all((a["coef"] == b["coef"]).all() for a, b in zip(plain_read(data), read["components"]))
        assert M.rgb_tensor(read).shape == (read["height"], read["width"], 3)
        assert sum(int(np.abs(c["coef"]).sum()) for c in read["components"])


def test_broken_and_other_files_are_refused():
    whole = M.encode_payload(bytes(range(64)) * 300)
    at = whole.index(b"\xff\xda") + 14
    many = whole.index(b"\xff\xd0")
    for data in (
        whole.replace(b"\xff\xc2", b"\xff\xc0", 1),  # not progressive
        whole[:at] + whole[at + 40 :],  # a scan too short
        whole[:many] + whole[many + 2 :],  # a restart marker less
        whole[: len(whole) // 2],
        b"GIF89a",
        plain_write(16, 16, [(1, 1)], [np.zeros((4, 64))], ONE, 0).replace(b"\xff\xc2\x00\x0b\x08", b"\xff\xc2\x00\x0b\x0c"),  # 12 bits
        plain_write(48, 16, [(3, 1), (2, 1), (1, 1)], [np.zeros((k, 64)) for k in (12, 8, 4)], THREE, 0),  # 2 doesn't divide 3
    ):
        with pytest.raises(ValueError):
            M.read_coefficients(data)


def test_zigzag_is_a_permutation_by_diagonals():
    assert sorted(M.ZIGZAG.tolist()) == list(range(64))
    assert M.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and M.ZIGZAG[-1] == 63


def brute_rgb(read):
    """Samples by the definition of the transform, one at a time."""
    c = [math.sqrt(0.125)] + [0.5] * 7
    planes = []
    for comp in read["components"]:
        wide = comp["across"]
        plane = np.zeros((len(comp["coef"]) // wide * 8, wide * 8))
        for b, zz in enumerate(comp["coef"]):
            block = np.zeros(64)
            block[M.ZIGZAG] = zz
            for y in range(8):
                for x in range(8):
                    v = sum(
                        c[u] * c[w] * block[8 * w + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * w * math.pi / 16)
                        for u in range(8)
                        for w in range(8)
                    )
                    plane[b // wide * 8 + y, b % wide * 8 + x] = min(255, max(0, v + 128))
        planes.append(plane.repeat(read["vmax"] // comp["v"], 0).repeat(read["hmax"] // comp["h"], 1))
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)


def test_samples_match_the_definition():
    read = M.read_coefficients(M.encode_payload(random.Random(3).randbytes(64 * 6)))
    rgb = M.rgb_tensor(read)
    assert rgb.shape == (16, 16, 3) and rgb.dtype == np.uint8
    assert np.abs(rgb.astype(float) - brute_rgb(read)).max() <= 2.5


def test_long_images_are_transformed_in_bands():
    payload = random.Random(4).randbytes(64 * 30_000)
    read = M.read_coefficients(M.encode_payload(payload))
    assert M.payload_of(read) == payload
    rgb, c = M.rgb_tensor(read), read["components"][0]
    wide = c["across"]
    plane = M._samples(c["coef"], c["q"]).reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, wide * 8)
    assert rgb.shape == (*plane.shape, 3)
    middle = (read["components"][1]["coef"] == 0).all()
    assert not middle and rgb.std() > 1


def test_query_columns(spark, documents):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "a" * 64), (4, "a" * 64), (None, "b" * 65), (5, "long " * 30_000), (6, "\x01\x00\x7f" * 99)]
    got = M.digests(M.decode(M.store(documents(rows)))).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        media = M.encode_payload(payload)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and len(payload) % 64 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        rgb = M.rgb_tensor({**(read := M.read_coefficients(media)), "components": [{**c, "coef": p["coef"]} for c, p in zip(read["components"], plain_read(media))]}) if len(raw) < 999 else M.rgb_tensor(M.read_coefficients(media))
        means = [int(rgb[:, :, k].astype(int).sum()) * 1000 // (rgb.shape[0] * rgb.shape[1]) for k in range(3)]
        assert r.feature == f"{rgb.shape[0]}x{rgb.shape[1]}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(rgb.tobytes()):08x}"
    assert M.store(documents(rows).limit(0)).collect() == []
    assert M.digests(M.decode(M.store(documents(rows).limit(0)))).collect() == []


def test_tensor_column(spark, documents):
    text = os.urandom(100).hex()
    row = M.decode(M.store(documents([(1, text)]))).first()
    assert len(row.rgb) == row.height * row.width * 3 and row.payload[:200] == text.encode()
    foreign = plain_write(40, 37, [(1, 1)], [np.ones((25, 64))], ONE, 2)
    media = spark.createDataFrame([(1, 0, bytearray(foreign)), (2, 0, None), (3, 0, bytearray())], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in M.decode(media).collect()}
    assert (got[1].payload, got[1].height, got[1].width, len(got[1].rgb)) == (None, 37, 40, 37 * 40 * 3)
    assert [(got[k].payload, got[k].height, len(got[k].rgb)) for k in (2, 3)] == [(None, 0, 0)] * 2
