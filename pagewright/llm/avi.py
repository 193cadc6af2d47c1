"""Media columns: AVI files of motion-JPEG frames.

write_media() stores bytes as the samples of intra frames: a frame is a baseline grey JPEG whose 8x8 blocks are each of one
flat value, a payload byte, so its transform has a DC coefficient alone and any JPEG decoder gives the byte back exactly.
The Huffman tables are chosen so that the code of difference category s has 9 - s bits: with the s bits that follow, and
one bit for end-of-block, each sample takes 10 bits, and frames are coded as whole arrays.
read_media() walks the RIFF chunks, takes the frames that the index (idx1) lists, or those of the movi list where there is
no index, and decodes them. Frame is a baseline decoder: Huffman codes, DC and AC coefficients, restart intervals, several
components, inverse cosine transform; Frame.flat() reads the codes of frames with the tables above as whole arrays, to the
same values. Shots are cut where the histogram difference of neighbouring images exceeds the mean of the differences before
it in the shot by a factor and a floor; clips() yields a timed row for each. The payload of a file of write_media() is a
byte a block, up to the stored length; of any other file the samples of the first component, frame by frame.

Null texts are stored as the empty text, one block of padding. Very long texts become many frames of at most 64 x 64
bytes. Repeated rows have the same file each; an empty table stays empty. Extra columns pass through, those named like a
result are replaced. Files that are no AVI, hold no frame, or a frame that is no baseline JPEG, give a null payload and no
clips.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, slices, with_columns

WIDTH = 64  # blocks, and payload bytes, in a row of a frame
ROWS = 64  # rows of a frame at most
FPS = 25
UNIT = 64

# --- JPEG -------------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Fixed values of the format: category s has a code of 9 - s bits, so codes in order of length are for 8, 7, ... 0.
_DC_TABLE = bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))
_AC_TABLE = bytes([0x10, 1] + [0] * 15 + [0x00])  # one code, "0": end of block
_QUANT = bytes([0] + [8] + [1] * 63)  # a DC step of 8 makes the coefficient the sample's own value less 128
_TABLES = _segment(0xDB, _QUANT) + _segment(0xC4, _DC_TABLE) + _segment(0xC4, _AC_TABLE)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255 the ten bits of a sample; by the first nine bits the difference."""
    of, back = np.zeros(511, np.uint64), np.full(512, 0, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << (9 - s)) - 2  # k ones and a zero: canonical codes of lengths 1, 2, ... 9
        nine = (prefix << s) | (d if d > 0 else d + (1 << s) - 1)
        of[d + 255], back[nine] = nine << 1, d
    return of, back


_TEN, _DIFFERENCE = _codes()


def encode_frame(samples: np.ndarray) -> bytes:
    """samples: uint8 of (rows, WIDTH), one value for each 8x8 block."""
    rows, width = samples.shape
    v = samples.ravel().astype(np.int16) - 128
    d = np.diff(v, prepend=np.int16(0))
    q = _TEN[d + 255].reshape(-1, 4)
    forty = (q[:, 0] << np.uint64(30)) | (q[:, 1] << np.uint64(20)) | (q[:, 2] << np.uint64(10)) | q[:, 3]
    data = forty.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\x00")
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, width * 8, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _TABLES + frame + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + data + b"\xff\xd9"


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.left = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            self.word = (self.word << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.left += 8
        self.left -= n
        out = (self.word >> self.left) & ((1 << n) - 1)
        self.word &= (1 << self.left) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = (code << 1) | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")


def _value(bits: int, s: int) -> int:
    return bits if s == 0 or bits >> (s - 1) else bits - (1 << s) + 1


class Frame:
    """A baseline JPEG's headers and scan. ValueError for what is none."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at, self.quant, self.huffman, self.parts, self.restart, self.raw_tables, self.size = 2, {}, {}, [], 0, b"", (0, 0)
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, whole = data[at + 4 : at + 2 + size], data[at : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self.raw_tables += whole
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(float)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                self.raw_tables += whole
                while body:
                    counts, code, k, table = body[1:17], 0, 17, {}
                    for n, many in enumerate(counts, 1):
                        for _ in range(many):
                            table[n, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.huffman[body[0]] = table
                    body = body[k:]
            elif marker == 0xC0:
                depth, height, width, n = struct.unpack_from(">BHHB", body)
                self.size = (height, width)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if depth != 8:
                    raise ValueError("8-bit samples only")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("baseline frames only")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if not self.parts or not min(self.size) or any(not 1 <= x <= 4 for p in self.parts for x in p[1:3]) or any(p[0] not in tables for p in self.parts):
            raise ValueError("no frame header before the scan, or not all components in it")
        self.tables = tables
        self.scan = data[at : data.rindex(b"\xff\xd9")]

    def flat(self) -> np.ndarray | None:
        """The block values of a frame as encode_frame() makes it, all blocks at once; None for any other."""
        if len(self.parts) != 1 or self.raw_tables != _TABLES or self.restart:
            return None
        high, wide = (-(-x // 8) for x in self.size)
        ten = np.frombuffer(self.scan.replace(b"\xff\x00", b"\xff"), np.uint8)
        n = wide * high
        if n % 4 or len(ten) != n // 4 * 5:
            return None
        q = ten.reshape(-1, 5).astype(np.uint64)
        forty = (q[:, 0] << np.uint64(32)) | (q[:, 1] << np.uint64(24)) | (q[:, 2] << np.uint64(16)) | (q[:, 3] << np.uint64(8)) | q[:, 4]
        nine = np.stack([(forty >> np.uint64(k)) & np.uint64(511) for k in (31, 21, 11, 1)], 1).ravel()
        if (forty & np.uint64(0x0040100401)).any():  # an end-of-block bit that is no zero
            return None
        return (np.cumsum(_DIFFERENCE[nine], dtype=np.int64) + 128).astype(np.uint8).reshape(high, wide)

    def coefficients(self) -> list[np.ndarray]:
        """For each component the coefficients of its blocks, (block rows, block columns, 64) in zigzag order: every Huffman code of the interleaved scan is read."""
        runs, start, i = [], 0, 0
        while (i := self.scan.find(b"\xff", i)) >= 0 and i + 1 < len(self.scan):
            if 0xD0 <= self.scan[i + 1] <= 0xD7:
                runs.append(self.scan[start:i])
                start = i + 2
            i += 2
        runs.append(self.scan[start:])
        parts = [(self.parts[0][0], 1, 1, self.parts[0][3])] if len(self.parts) == 1 else self.parts
        across, down = max(p[1] for p in parts), max(p[2] for p in parts)
        columns, rows = -(-self.size[1] // (8 * across)), -(-self.size[0] // (8 * down))
        if 2 * columns * rows * sum(h * v for _, h, v, _ in parts) > 8 * len(self.scan):  # a block takes two codes of a bit or more
            raise ValueError("fewer bits than the blocks of the frame's size take")
        out = [np.zeros((rows * v, columns * h, 64)) for _, h, v, _ in parts]
        unit = 0
        for run in runs:
            bits, last = _Bits(run.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
            for _ in range(self.restart or columns * rows):
                if unit == columns * rows:
                    break
                for c, (name, h, v, _) in enumerate(parts):
                    dc, ac = self.huffman[self.tables[name] >> 4], self.huffman[0x10 | self.tables[name] & 15]
                    for b in range(h * v):
                        block = out[c][unit // columns * v + b // h, unit % columns * h + b % h]
                        s = bits.symbol(dc)
                        last[c] += _value(bits.take(s), s) if s else 0
                        block[0] = last[c]
                        k = 1
                        while k < 64:
                            rs = bits.symbol(ac)
                            k += rs >> 4
                            if rs & 15:
                                if k > 63:
                                    raise ValueError("a coefficient beyond the block")
                                block[k] = _value(bits.take(rs & 15), rs & 15)
                            elif rs != 0xF0:
                                break
                            k += 1
                unit += 1
        return out

    def planes(self) -> list[np.ndarray]:
        """For each component its samples, uint8 of (height, width): inverse transform, then repeated where it has fewer samples than the image."""
        height, width = self.size
        across, down = (max(p[i] for p in self.parts) for i in (1, 2))
        out = []
        for (_, h, v, q), blocks in zip(self.parts, self.coefficients(), strict=True):
            square = np.zeros(blocks.shape)
            square[..., _ZIGZAG] = blocks * self.quant[q]
            pixels = np.einsum("ux,rcuv,vy->rxcy", _COSINES, square.reshape(*blocks.shape[:2], 8, 8), _COSINES).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
            whole = pixels if len(self.parts) == 1 else pixels.repeat(down // v, 0).repeat(across // h, 1)
            out.append(np.clip(np.rint(whole[:height, :width] + 128), 0, 255).astype(np.uint8))
        return out

    def values(self) -> np.ndarray:
        """The value of each block of the first component, its mean: uint8 of (block rows, block columns)."""
        found = self.flat()
        if found is not None:
            return found
        high, wide = (-(-x // 8) for x in self.size)
        means = self.coefficients()[0][:high, :wide, 0] * self.quant[self.parts[0][3]][0] / 8 + 128
        return np.clip(np.rint(means), 0, 255).astype(np.uint8)


#: Fixed values of the format: the order of coefficients along the diagonals, from a rule.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


# --- AVI --------------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of UNIT."""
    return data + b"\0" * (-len(data) % UNIT or (UNIT if not data else 0))


def write_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of UNIT bytes. The last frame is filled with zeros; an INFO chunk keeps the length."""
    lines = len(payload) // WIDTH
    rows = -(-lines // -(-lines // ROWS))
    each = rows * WIDTH
    samples = np.frombuffer(payload + b"\0" * (-len(payload) % each), np.uint8).reshape(-1, rows, WIDTH)
    frames = [encode_frame(x) for x in samples]
    longest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, longest * FPS, 0, 0x10, len(frames), 0, 1, longest, WIDTH * 8, rows * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), longest, 0xFFFFFFFF, 0, 0, 0, WIDTH * 8, rows * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH * 8, rows * 8, 1, 8, b"MJPG", WIDTH * 8 * rows * 8, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    index, at = io.BytesIO(), 4
    for f in frames:
        index.write(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movi = _list(b"movi", *(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + head + info + movi + _chunk(b"idx1", index.getvalue()))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def _listed(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Place and size of the frames of a list, also of the rec lists in it."""
    for name, a, size in _chunks(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _listed(data, a + 4, a + size)
        elif name[2:] in (b"dc", b"db"):
            yield a, size


def parse_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """The frames that the index lists, in its order, or, without an index, those of the movi list in theirs; frames a second; the stored payload length, if any."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    index, movi, fps, length, end = None, None, float(FPS), None, 0
    for name, at, size in _chunks(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"movi":
            movi, end = at, at + size
        elif name == b"LIST" and kind == b"hdrl":
            for n, a, s in _chunks(data, at + 4, at + size):
                if n == b"avih" and s >= 4 and (us := struct.unpack_from("<I", data, a)[0]):
                    fps = 1e6 / us
        elif name == b"LIST" and kind == b"INFO":
            for n, a, s in _chunks(data, at + 4, at + size):
                if n == b"ICMT" and data[a : a + 8] == b"payload=":
                    length = int(data[a + 8 : a + s].rstrip(b"\0"))
        elif name == b"idx1":
            index = [(data[a : a + 4], *struct.unpack_from("<II", data, a + 8)) for a in range(at, at + size - 15, 16)]
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return [data[a : a + n] for a, n in _listed(data, movi + 4, end)], fps, length
    base = movi if not index or data[movi + index[0][1] : movi + index[0][1] + 4] == index[0][0] else 0  # or from the file's start
    return [data[base + at + 8 : base + at + 8 + size] for name, at, size in index if name[2:] in (b"dc", b"db")], fps, length


def shots(images: list[np.ndarray], factor: float = 3.0, floor: float = 0.15) -> list[tuple[int, int]]:
    """[first, last] frames of each shot. A cut: the histogram difference (0 to 1) is over `floor` and over `factor` times the mean of those before it in the shot."""
    out, start, total, n, last = [], 0, 0.0, 0, None
    for i, image in enumerate(images):
        histogram = np.bincount(image.ravel() >> 3, minlength=32) / image.size
        if last is not None:
            d = 0.5 * float(np.abs(histogram - last).sum())
            if d > floor and (n == 0 or d > factor * total / n):
                out.append((start, i - 1))
                start, total, n = i, 0.0, 0
            else:
                total, n = total + d, n + 1
        last = histogram
    return out + [(start, len(images) - 1)] if images else out


# --- columns ----------------------------------------------------------------------------------------------------------


def write_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds media binary, the AVI file of the text's padded UTF-8 bytes, and n_bytes long; the text is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [(t or "").encode() for t in b.column(text).to_pylist()]
            yield with_columns(b, (text,), n_bytes=pa.array(map(len, raw), pa.int64()), media=pa.array([write_avi(padded(x)) for x in raw], pa.binary()))

    return docs.mapInArrow(run, schema_with(docs, (text,), n_bytes="bigint", media="binary"))


_CLIP = "struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double>"
_CLIP_TYPE = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def _read(data: bytes | None) -> tuple[bytes | None, list[dict], str | None]:
    try:
        frames, fps, length = parse_avi(data or b"")
        # a file of write_media() has a byte a block; of any other file the first component's samples are read
        images = [Frame(f).values() if length is not None else Frame(f).planes()[0] for f in frames]
    except (ValueError, IndexError, KeyError, struct.error):
        return None, [], None
    if not images:
        return None, [], None
    payload = b"".join(x.tobytes() for x in images)
    payload = payload if length is None else payload[:length]
    cut = shots(images)
    clips = [{"clip": i, "first_frame": a, "last_frame": b, "start_s": a / fps, "end_s": (b + 1) / fps} for i, (a, b) in enumerate(cut)]
    samples = np.frombuffer(payload, np.uint8)
    mean = int(samples.sum(dtype=np.int64)) * 1000 // max(1, samples.size)
    height, width = images[0].shape
    each = 1 if length is None else 8
    return payload, clips, f"frames={len(images)};size={width * each}x{height * each};shots={len(cut)};cuts={','.join(str(a) for a, _ in cut[1:])};mean_milli={mean}"


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds payload binary (the samples read back), clips array and feature string to rows with an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [_read(x) for x in b.column(media).to_pylist()]
            yield with_columns(b, (), payload=pa.array([x[0] for x in found], pa.binary()), clips=pa.array([x[1] for x in found], _CLIP_TYPE), feature=pa.array([x[2] for x in found], pa.string()))

    return df.mapInArrow(run, schema_with(df, (), payload="binary", clips=f"array<{_CLIP}>", feature="string"))


def clips(read: DataFrame) -> DataFrame:
    """A row for each shot: the other columns, clip, first_frame, last_frame, start_s, end_s."""
    keep = [c for c in read.columns if c not in ("payload", "clips", "media")]
    return read.select(*(F.col(f"`{c}`") for c in keep), F.inline("clips"))
