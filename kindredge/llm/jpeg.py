"""Progressive JPEG in numpy: scans into coefficient arrays, inverse transform, chroma upsampling, RGB tensors.

``decode`` reads any 8-bit Huffman-coded progressive file (spectral selection, successive approximation, interleaved and
single-component scans, restart intervals) into zigzag-ordered coefficient arrays. Scans whose code words and extra bits
always take the same number of bits together are read at once in numpy; all others bit by bit.

``encode_bytes`` stores a byte string losslessly, a byte in each coefficient: byte b is the value -m or m, m = 2 + b // 2,
so that a first scan with one bit held back never has a zero. Its Huffman tables give a code word of n - s bits to
coefficients of s extra bits, so that every coefficient takes n bits.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BLOCK_BYTES = 576
FILLER = 255


@functools.lru_cache(None)
def zigzag() -> np.ndarray:
    """Raster position of each zigzag index: diagonals in turn, alternating direction."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@functools.lru_cache(None)
def inverse_transform() -> np.ndarray:
    """64 x 64: zigzag-ordered coefficients to raster samples."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.kron(basis, basis).astype(np.float32)[zigzag()]


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row and in a column of scans of this component alone
    high: int = 0
    row: int = 0  # blocks in a row, with those that fill up whole units
    coef: np.ndarray = None


@dataclass
class Image:
    width: int
    height: int
    parts: list[Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)


class Huffman:
    """A canonical code: ``lengths`` counts code words of 1 to 16 bits, ``symbols`` are in order."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[bits, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.lookup = {s: (bits, code) for (bits, code), s in self.codes.items()}

    @functools.lru_cache(None)  # noqa: B019  tables are few and cached themselves
    def window(self, ac: bool) -> tuple[int, np.ndarray] | None:
        """(n, values) if all plain symbols (no zero run) take n bits with their extra bits: the value of each n-bit
        window, or ``BAD`` where another symbol starts."""
        plain = {s: x for s, x in self.lookup.items() if (0 < s < 16 if ac else s < 12)}
        totals = {bits + s for s, (bits, _) in plain.items()}
        if len(totals) != 1 or (n := totals.pop()) > 16:
            return None
        values = np.full(1 << n, BAD, np.int32)
        for s, (bits, code) in plain.items():
            raw = np.arange(1 << s)
            values[(code << s) + raw] = np.where(raw >= (1 << s >> 1), raw, raw - (1 << s) + 1)
        return n, values


BAD = 1 << 20


class Bits:
    """Entropy-coded bytes without stuffing, bit by bit; past the end there are ones."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def take(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = 2 * x + self.one()
        return x

    def symbol(self, table: Huffman) -> int:
        code = 0
        for bits in range(1, 17):
            code = 2 * code + self.one()
            if (bits, code) in table.codes:
                return table.codes[bits, code]
        raise ValueError("not a code word")

    def value(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def windows(data: bytes, n: int, count: int, first: int = 0) -> np.ndarray | None:
    """``count`` numbers of n bits from bit ``first`` on; None if the data end before."""
    if first + n * count > 8 * len(data):
        return None
    raw = np.frombuffer(data, np.uint8)
    if n == 8 and first == 0:
        return raw[:count]
    bits = np.unpackbits(raw[: (first + n * count + 7) // 8])[first: first + n * count]
    if n == 1:
        return bits
    wide = np.zeros((count, 16), np.uint8)
    wide[:, 16 - n:] = bits.reshape(count, n)
    return np.packbits(wide, axis=1).view(">u2")[:, 0]


# ---------------------------------------------------------------- decoding

def _scan(image: Image, parts, dc: dict, ac: dict, lo: int, hi: int, was: int, now: int, segments: list[bytes], interval: int) -> None:
    if len(parts) == 1:
        p = parts[0][0]
        blocks = (np.arange(p.high)[:, None] * p.row + np.arange(p.wide)).ravel()
        owner, each = np.zeros(len(blocks), np.intp), 1
    else:
        across = image.parts[0].row // image.parts[0].h
        down = len(image.parts[0].coef) // image.parts[0].row // image.parts[0].v
        my, mx = (x.ravel() for x in np.meshgrid(np.arange(down), np.arange(across), indexing="ij"))
        cols, names = [], []
        for j, (p, *_) in enumerate(parts):
            for y in range(p.v):
                for x in range(p.h):
                    cols.append((my * p.v + y) * p.row + mx * p.h + x)
                    names.append(j)
        blocks, owner, each = np.stack(cols, 1).ravel(), np.tile(names, len(my)), len(cols)
    step = interval * each if interval else max(1, len(blocks))
    for k, a in enumerate(range(0, len(blocks), step)):
        data = segments[k] if k < len(segments) else b""
        b, o = blocks[a: a + step], owner[a: a + step]
        if lo == 0 and was == 0:
            _dc_first(parts, dc, b, o, now, data)
        elif lo == 0:
            _dc_refine(parts, b, o, now, data)
        elif was == 0:
            _ac_first(parts[0][0], ac[parts[0][2]], b, lo, hi, now, data)
        else:
            _ac_refine(parts[0][0], ac[parts[0][2]], b, lo, hi, now, data)


def _dc_first(parts, dc, blocks, owner, now, data) -> None:
    tables = {t for _, t, _ in parts}
    fast = dc[tables.pop()].window(False) if len(tables) == 1 else None
    got = windows(data, fast[0], len(blocks)) if fast else None
    diff = fast[1][got] if got is not None else None
    if diff is None or (diff == BAD).any():
        bits, diff = Bits(data), np.zeros(len(blocks), np.int64)
        for i, o in enumerate(owner.tolist()):
            diff[i] = bits.value(bits.symbol(dc[parts[o][1]]))
    for j, (p, *_) in enumerate(parts):
        own = owner == j
        p.coef[blocks[own], 0] = np.cumsum(diff[own]) << now


def _dc_refine(parts, blocks, owner, now, data) -> None:
    bits = windows(data, 1, len(blocks))
    for j, (p, *_) in enumerate(parts):
        own = owner == j
        p.coef[blocks[own], 0] |= bits[own].astype(p.coef.dtype) << now


def _ac_first(p, table, blocks, lo, hi, now, data) -> None:
    fast = table.window(True)
    got = windows(data, fast[0], len(blocks) * (hi - lo + 1)) if fast else None
    if got is not None:
        values = fast[1][got]
        if not (values == BAD).any():
            p.coef[blocks, lo: hi + 1] = values.reshape(len(blocks), -1) << now if now == 0 else values.reshape(len(blocks), -1) * (1 << now)
            return
    bits, run = Bits(data), 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = lo
        while k <= hi:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                p.coef[b, k] = bits.value(size) * (1 << now)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _ac_refine(p, table, blocks, lo, hi, now, data) -> None:
    """Correction bits of coefficients already met, and new coefficients of size one between them."""
    part = p.coef[blocks, lo: hi + 1]
    bits, at = None, 0
    if part.all():  # every coefficient has one correction bit: whole end-of-block runs are read at once
        at, done, corrections = 0, 0, []
        while done < len(blocks):
            head = Bits(data[at // 8: at // 8 + 6])
            head.at = at % 8
            zeros, size = divmod(head.symbol(table), 16)
            if size or zeros == 15:
                corrections = None
                break
            run = (1 << zeros) + head.take(zeros)
            at = at // 8 * 8 + head.at
            n = min(run, len(blocks) - done) * (hi - lo + 1)
            got = windows(data, 1, n, at)
            if got is None:
                corrections = None
                break
            corrections.append(got)
            at += n
            done += run
        if corrections is not None:
            add = np.concatenate(corrections).reshape(part.shape).astype(part.dtype) << now
            p.coef[blocks, lo: hi + 1] = np.where(part > 0, part + add, part - add)
            return
    bits, run = Bits(data), 0
    for b in blocks.tolist():
        c, k = p.coef[b], lo
        if not run:
            while k <= hi:
                zeros, size = divmod(bits.symbol(table), 16)
                new = 0
                if size:
                    new = 1 << now if bits.one() else -(1 << now)
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= hi:
                    if c[k]:
                        if bits.one():
                            c[k] += (1 << now) if c[k] > 0 else -(1 << now)
                    elif zeros:
                        zeros -= 1
                    else:
                        c[k] = new
                        k += 1
                        break
                    k += 1
        if run:
            for k in range(k, hi + 1):
                if c[k] and bits.one():
                    c[k] += (1 << now) if c[k] > 0 else -(1 << now)
            run -= 1


@functools.lru_cache(64)
def _table(raw: bytes) -> Huffman:
    return Huffman(raw[:16], raw[16:])


def decode(data: bytes) -> Image:
    """The coefficient arrays of a progressive file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, quant, dc, ac, interval = 2, None, {}, {}, {}, 0
    while at < len(data):
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2: at + 4])
        body, at = data[at + 4: at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[n:]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _table(body[1:n])
                body = body[n:]
        elif kind == 0xDD:
            interval = int.from_bytes(body)
        elif kind == 0xC2:
            height, width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            hs, vs = max(p.h for p in parts), max(p.v for p in parts)
            across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
            for p in parts:
                p.wide, p.high = -(-(-(-width * p.h // hs)) // 8), -(-(-(-height * p.v // vs)) // 8)
                p.row, p.coef = across * p.h, np.zeros((across * p.h * down * p.v, 64), np.int32)
            image = Image(width, height, parts, quant)
        elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not a progressive file")
        elif kind == 0xDA:
            chosen = [(next(p for p in image.parts if p.ident == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            lo, hi, bits = body[1 + 2 * body[0]:]
            start, segments = at, []
            while True:  # up to the next marker; stuffed bytes are unstuffed, restarts end a segment
                at = data.index(b"\xff", at)
                if data[at + 1] == 0:
                    at += 2
                    continue
                segments.append(data[start:at].replace(b"\xff\x00", b"\xff"))
                if not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                start = at = at + 2
            _scan(image, chosen, dc, ac, lo, hi, bits >> 4, bits & 15, segments, interval)
    return image


def rgb(image: Image) -> np.ndarray:
    """Full-resolution height x width x 3 samples; one component gives grey. Chroma is upsampled by repetition."""
    hs, vs = max(p.h for p in image.parts), max(p.v for p in image.parts)
    planes = []
    for p in image.parts:
        samples = (p.coef * image.quant[p.table]).astype(np.float32) @ inverse_transform() + 128
        plane = samples.reshape(-1, p.row, 8, 8).transpose(0, 2, 1, 3).reshape(-1, p.row * 8)
        plane = np.clip(np.rint(plane), 0, 255)
        if p.v != vs:
            plane = plane.repeat(vs // p.v, 0)
        if p.h != hs:
            plane = plane.repeat(hs // p.h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.uint8)
    out[:, :, 0] = np.clip(np.rint(y + 1.402 * cr), 0, 255)
    out[:, :, 1] = np.clip(np.rint(y - 0.344136 * cb - 0.714136 * cr), 0, 255)
    out[:, :, 2] = np.clip(np.rint(y + 1.772 * cb), 0, 255)
    return out


# ---------------------------------------------------------------- encoding of byte strings

SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
UNIT = sum(h * v for _, h, v in SAMPLING)  # blocks in a unit of 16 x 16 samples
BANDS = ((1, 5), (6, 63))
#: total bits of a DC difference, of a first-scan AC coefficient
DC_BITS, AC_BITS = 9, 8


def _marker(kind: int, body: bytes) -> bytes:
    return bytes((255, kind)) + (len(body) + 2).to_bytes(2) + body


def _counts(lengths: list[int]) -> bytes:
    return bytes(lengths.count(n) for n in range(1, 17))


DC_TABLE = _counts([DC_BITS - s for s in range(8, -1, -1)]) + bytes(range(8, -1, -1))
AC_TABLE = _counts([AC_BITS - s for s in range(7, 0, -1)] + [AC_BITS]) + bytes([*range(7, 0, -1), 0])
RUN_TABLE = _counts([4] * 15) + bytes(n << 4 for n in range(15))


@functools.lru_cache(None)
def _words(ac: bool) -> np.ndarray:
    """The window that stands for each value; values from -256 on."""
    n, values = _table(AC_TABLE if ac else DC_TABLE).window(ac)
    out = np.zeros(512, np.uint16)
    good = np.flatnonzero(values != BAD)
    out[values[good] + 256] = good
    return out


@functools.lru_cache(None)
def _byte_values() -> np.ndarray:
    b = np.arange(256)
    return np.where(b & 1, -(2 + b // 2), 2 + b // 2).astype(np.int32)


def _pack(bits: np.ndarray) -> bytes:
    if len(bits) % 8:
        bits = np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))
    return np.packbits(bits).tobytes()


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - n:].ravel()


def _emit(parts: list[tuple[int, int]], lo: int, hi: int, was: int, now: int, data: bytes) -> bytes:
    head = bytes([len(parts), *(x for p, t in parts for x in (p, t)), lo, hi, was << 4 | now])
    return _marker(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def shape(blocks: int) -> tuple[int, int]:
    """Units across and down of the image that holds so many blocks."""
    units = max(1, -(-blocks // UNIT))
    down = -(-units // 4095)
    return -(-units // down), down


def encode_bytes(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients hold ``payload`` (a multiple of 64 bytes)."""
    across, down = shape(len(payload) // 64)
    units = across * down
    raw = np.full(units * UNIT * 64, FILLER, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    coef, at, blocks = _byte_values()[raw].reshape(-1, 64), 0, {}
    for ident, h, v in SAMPLING:
        blocks[ident] = coef[at: at + units * h * v]
        at += units * h * v
    grid = blocks[1].reshape(down, 2, across, 2, 64)[..., 0].transpose(0, 2, 1, 3).reshape(units, 4)
    dc = np.concatenate((grid, blocks[2][:, :1], blocks[3][:, :1]), 1)  # in the order of interleaved units
    high = dc >> 1
    diff = np.empty_like(high)
    luma = high[:, :4].ravel()
    diff[:, :4] = np.diff(luma, prepend=0).reshape(-1, 4)
    diff[:, 4:] = np.diff(high[:, 4:], axis=0, prepend=0)
    one = b"\x01" * 64
    out = [b"\xff\xd8", _marker(0xDB, b"\x00" + one), _marker(0xC2, bytes([8]) + (16 * down).to_bytes(2) + (16 * across).to_bytes(2) + bytes([3]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in SAMPLING)),
           _marker(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE + b"\x11" + RUN_TABLE)]
    everyone = [(1, 0), (2, 0), (3, 0)]
    out.append(_emit(everyone, 0, 0, 0, 1, _pack(_bits(_words(False)[diff.ravel() + 256], DC_BITS))))
    words = _words(True)
    for ident in blocks:
        first = words[np.sign(blocks[ident]) * (np.abs(blocks[ident]) >> 1) + 256].astype(np.uint8)
        for lo, hi in BANDS:
            out.append(_emit([(ident, 0)], lo, hi, 0, 1, first[:, lo: hi + 1].tobytes()))
    for ident in blocks:
        low, bits, codes = (np.abs(blocks[ident][:, 1:]) & 1).astype(np.uint8), [], _table(RUN_TABLE).lookup
        for a in range(0, len(low), 1 << 14):
            part = low[a: a + (1 << 14)]
            n = len(part).bit_length() - 1
            width, code = codes[n << 4]
            head = (code << n) + len(part) - (1 << n)
            bits += [np.array([head >> k & 1 for k in range(width + n - 1, -1, -1)], np.uint8), part.ravel()]
        out.append(_emit([(ident, 1)], 1, 63, 1, 0, _pack(np.concatenate(bits))))
    out.append(_emit(everyone, 0, 0, 1, 0, _pack((dc & 1).astype(np.uint8).ravel())))
    return b"".join([*out, b"\xff\xd9"])


def stored_bytes(image: Image, size: int) -> bytes:
    """The ``size`` bytes that ``encode_bytes`` put into the coefficients."""
    values = np.concatenate([p.coef.ravel() for p in image.parts])[:size]
    return ((np.abs(values) - 2) * 2 + (values < 0)).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- the columns

def payload_of(text: bytes) -> bytes:
    return text + bytes([FILLER]) * (max(1, -(-len(text) // BLOCK_BYTES)) * BLOCK_BYTES - len(text))


def feature_of(tensor: np.ndarray) -> str:
    """Size, mean and spread of each channel, from whole-number sums."""
    flat = tensor.reshape(-1, 3)
    n, sums, squares = len(flat), flat.sum(0, dtype=np.int64), np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    cells = [f"{s / n:.4f}~{max(0.0, q / n - (s / n) ** 2) ** 0.5:.4f}" for s, q in zip(sums.tolist(), squares.tolist(), strict=True)]
    return f"{tensor.shape[1]}x{tensor.shape[0]} " + " ".join(cells)


def _media(batches, tensors: bool):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "rgb", "height", "width"] * tensors
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.binary(), pa.int32(), pa.int32()] * tensors
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            payload = payload_of(text or b"")
            media = encode_bytes(payload)
            image = decode(media)
            back, tensor = stored_bytes(image, len(payload)), rgb(image)
            rows.append((doc, len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(tensor)) + ((media, tensor.tobytes(), *tensor.shape[:2]) if tensors else ()))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)


def media_columns(docs: DataFrame, tensors: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> a row a document: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; with ``tensors`` also the file, the RGB samples and their height and width.

    The UTF-8 text (null: empty), filled up with bytes 255 to a positive multiple of 576, is stored as a progressive file
    and read back from it. Null doc_ids are carried, repeated rows give equal rows, an empty table an empty one, and
    texts of any length are taken whole."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(lambda batches: _media(batches, tensors), schema + ", media binary, rgb binary, height int, width int" * tensors)
