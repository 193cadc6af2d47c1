"""AVI files and JPEG frames: an encoder of the test's own with AC terms and several components, files without an index, broken ones."""

import math
import random
import struct

import numpy as np
import pytest

from pagewright.llm import avi

DOC = "doc_id long, text string, media string, feature string"
TEXTS = [None, "", " ", "a", "日本語 😀", "x" * 300_000, "same", "same"]
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
AC = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def signed(self, v, s):
        self.put(v if v > 0 else v + (1 << s) - 1, s)

    def bytes(self):
        whole = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00")


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(size, parts, quant, blocks, restart=0):
    """blocks: for each unit of the scan the blocks (component, 64 coefficients in zigzag order). Codes of equal length: 4 bits for DC categories, 8 for AC symbols."""
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, bytes([0, *quant])) + segment(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])) + segment(0xC4, bytes([0x10, *[0] * 7, len(AC), *[0] * 8, *AC]))
    head += segment(0xC0, struct.pack(">BHHB", 8, *size, len(parts)) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in parts))
    head += segment(0xDD, struct.pack(">H", restart)) if restart else b""
    out, w, last = b"", Writer(), {}
    for u, unit in enumerate(blocks):
        if restart and u and u % restart == 0:
            out += w.bytes() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            w, last = Writer(), {}
        for c, z in unit:
            d = z[0] - last.get(c, 0)
            last[c] = z[0]
            s = abs(d).bit_length()
            w.put(s, 4)
            w.signed(d, s)
            run, end = 0, max([k for k in range(1, 64) if z[k]], default=0)
            for k in range(1, end + 1):
                if not z[k]:
                    run += 1
                    continue
                while run > 15:
                    w.put(AC.index(0xF0), 8)
                    run -= 16
                s = abs(z[k]).bit_length()
                w.put(AC.index(run << 4 | s), 8)
                w.signed(z[k], s)
                run = 0
            if end < 63:
                w.put(AC.index(0x00), 8)
    return head + segment(0xDA, bytes([len(parts), *(x for i, _, _ in parts for x in (i, 0)), 0, 63, 0])) + out + w.bytes() + b"\xff\xd9"


def inverse(z, quant):
    """The 64 samples of a block by the definition."""
    f = [0.0] * 64
    for k in range(64):
        f[ZIGZAG[k]] = z[k] * quant[k]
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    cos = [[math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8)] for x in range(8)]
    return [[sum(c(u) * c(v) * f[u * 8 + v] * cos[x][u] * cos[y][v] for u in range(8) for v in range(8)) / 4 + 128 for y in range(8)] for x in range(8)]


def some_block(rng):
    z = [rng.randrange(-60, 60)] + [0] * 63
    for _ in range(rng.randrange(12)):
        z[rng.randrange(1, 64)] = rng.randrange(-20, 21)
    return z


@pytest.mark.parametrize("restart", [0, 2])
def test_frames_with_ac_terms_and_components(restart):
    rng = random.Random(restart)
    quant = [rng.randrange(1, 6) for _ in range(64)]
    parts = [(1, 2, 2), (2, 1, 1), (3, 1, 1)]
    height, width, across, down = 27, 41, 3, 2
    units = [[(0, some_block(rng)) for _ in range(4)] + [(1, some_block(rng)), (2, some_block(rng))] for _ in range(across * down)]
    frame = avi.Frame(jpeg((height, width), parts, quant, units, restart))
    want = [np.zeros((down * 16, across * 16)) for _ in parts]
    for u, unit in enumerate(units):
        top, left = u // across * 16, u % across * 16
        for b, (c, z) in enumerate(unit):
            pixels = np.array(inverse(z, quant))
            if c == 0:
                want[0][top + b // 2 * 8 : top + b // 2 * 8 + 8, left + b % 2 * 8 : left + b % 2 * 8 + 8] = pixels
            else:
                want[c][top : top + 16, left : left + 16] = pixels.repeat(2, 0).repeat(2, 1)
    assert frame.flat() is None
    for got, w in zip(frame.planes(), want, strict=True):
        assert np.abs(got - np.clip(w[:height, :width], 0, 255)).max() <= 0.5 + 1e-6
    means = want[0].reshape(down * 2, 8, across * 2, 8).mean((1, 3))[: -(-height // 8), : -(-width // 8)]
    assert np.abs(frame.values() - np.clip(means, 0, 255)).max() <= 0.5 + 1e-6


def test_flat_frames_read_alike_either_way():
    rng = np.random.default_rng(3)
    for rows in (1, 5, 64):
        samples = rng.integers(0, 256, (rows, avi.WIDTH)).astype(np.uint8)
        frame = avi.Frame(avi.encode_frame(samples))
        assert (frame.flat() == samples).all()
        assert (frame.planes()[0] == samples.repeat(8, 0).repeat(8, 1)).all()
        assert (np.rint(frame.coefficients()[0][..., 0] + 128) == samples).all()


def test_round_trip_of_texts(spark):
    rng = random.Random(10)
    for n in (0, 1, 63, 64, 65, 4096, 70_000):
        data = avi.padded(rng.randbytes(n))
        file = avi.write_avi(data)
        assert len(data) % 64 == 0 and len(data) >= max(64, n)
        frames, fps, length = avi.parse_avi(file)
        assert (fps, length) == (25.0, len(data)) and avi._read(file)[0] == data
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], DOC)
    read = avi.read_media(avi.write_media(d))
    assert {r["doc_id"]: bytes(r["payload"]) for r in read.collect()} == {i: avi.padded((t or "").encode()) for i, t in enumerate(TEXTS)}
    assert avi.clips(read).filter("clip = 0").count() == len(TEXTS)
    assert avi.read_media(avi.write_media(d.limit(0))).count() == 0


def test_files_without_an_index_and_broken_ones(spark):
    data = avi.padded(bytes(range(256)) * 40)
    file = avi.write_avi(data)
    at = file.rindex(b"idx1")
    bare = file[:at]
    assert avi._read(bare)[0] == data
    movi = bare.index(b"movi")
    rec = avi._chunk(b"LIST", b"rec " + bare[movi + 4 :])
    assert avi._read(bare[: movi - 8] + avi._list(b"movi", rec))[0] == data
    foreign = file.replace(b"payload=", b"comment=")
    whole = [avi.Frame(f).flat().repeat(8, 0).repeat(8, 1).tobytes() for f in avi.parse_avi(file)[0]]
    assert avi._read(foreign)[0] == b"".join(whole)
    one = avi._chunk(b"RIFF", b"AVI " + avi._list(b"movi", avi._chunk(b"00dc", b"\xff\xd8" + segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\xff\xd9")))
    none = avi._chunk(b"RIFF", b"AVI " + avi._list(b"movi"))
    at = file.index(b"\xff\xc0")
    huge = file[: at + 5] + struct.pack(">HH", 65_528, 65_528) + file[at + 9 :]  # a size that no frame of so few bytes has
    assert avi._read(huge) == (None, [], None) == avi._read(huge.replace(b"payload=", b"comment="))
    cut = [file[:n] for n in range(0, 900, 7)]
    rows = [(i, None if x is None else bytearray(x)) for i, x in enumerate([None, b"", b"RIFFxxxxAVI ", one, none, file[:-1], *cut])]
    read = {r["doc_id"]: r for r in avi.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert all(read[i]["payload"] is None and not read[i]["clips"] for i in range(5)) and len(read) == len(rows)


def test_shots():
    dark, light = np.zeros((4, 64), np.uint8), np.full((4, 64), 200, np.uint8)
    assert avi.shots([dark, dark, light, light, light, dark]) == [(0, 1), (2, 4), (5, 5)]
