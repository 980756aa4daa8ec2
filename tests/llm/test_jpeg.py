"""The decoder is held against a plain serial encoder of arbitrary coefficients, and the store against round trips."""

import hashlib
import random
import zlib

import numpy as np

from kindredge.llm import jpeg as J


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def sym(self, table, s):
        n, code = J._table(table).lookup[s]
        self.put(code, n)

    def val(self, v):
        s = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << s) - 1, s)

    def done(self):
        return J._pack(np.array(self.bits, np.uint8)) if self.bits else b""


#: a code in which all symbols have nine bits
FLAT = J._counts([9] * 192) + bytes(s for s in range(256) if s & 15 < 12)


def ac_first(w, block, lo, hi, al, state):
    run = 0
    last = max((k for k in range(lo, hi + 1) if abs(block[k]) >> al), default=lo - 1)
    if last < lo:
        state[0] += 1
        return
    flush(w, state)
    for k in range(lo, last + 1):
        m = abs(int(block[k])) >> al
        if not m:
            run += 1
            continue
        while run > 15:
            w.sym(FLAT, 0xF0)
            run -= 16
        v = m if block[k] > 0 else -m
        w.sym(FLAT, run << 4 | m.bit_length())
        w.val(v)
        run = 0
    if last < hi:
        state[0] += 1


def flush(w, state):
    if state[0]:
        n = state[0].bit_length() - 1
        w.sym(FLAT, n << 4)
        w.put(state[0] - (1 << n), n)
        w.bits += state[1]
        state[0], state[1] = 0, []


def ac_refine(w, block, lo, hi, al, state):
    last = max((k for k in range(lo, hi + 1) if abs(block[k]) >> al == 1), default=lo - 1)
    held, run = [], 0
    for k in range(lo, hi + 1):
        m = abs(int(block[k])) >> al
        if not m:
            run += 1
            continue
        if k <= last:
            while run > 15:
                flush(w, state)
                w.sym(FLAT, 0xF0)
                w.bits += held
                held, run = [], run - 16
        if m > 1:
            held.append(m & 1)
            continue
        flush(w, state)
        w.sym(FLAT, run << 4 | 1)
        w.put(int(block[k] > 0), 1)
        w.bits += held
        held, run = [], 0
    if run or held:
        state[0] += 1
        state[1] += held


def write(width, height, comps, coefs, restart=0):
    hs, vs = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    out = [b"\xff\xd8", J._marker(0xDB, b"\x00" + bytes(range(1, 65))), J._marker(0xC2, bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([len(comps)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in comps)),
           J._marker(0xC4, b"\x00" + FLAT), J._marker(0xC4, b"\x10" + FLAT)]
    if restart:
        out.append(J._marker(0xDD, restart.to_bytes(2)))

    def emit(ids, lo, hi, ah, al, segments):
        body = b"".join(s.replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + k % 8]) if k < len(segments) - 1 else b"") for k, s in enumerate(segments))
        out.append(J._marker(0xDA, bytes([len(ids)]) + b"".join(bytes([i, 0]) for i in ids) + bytes([lo, hi, ah << 4 | al])) + body)

    def dc(ah, al):
        segments, w, pred, n = [], Writer(), [0] * len(comps), 0
        units = [(0, b) for b in alone(0)] if len(comps) == 1 else None
        mcus = [[u] for u in units] if units else [[(j, (my * v + y) * across * h + mx * h + x) for j, (_, h, v) in enumerate(comps) for y in range(v) for x in range(h)] for my in range(down) for mx in range(across)]
        for mcu in mcus:
            if restart and n and n % restart == 0:
                segments.append(w.done())
                w, pred = Writer(), [0] * len(comps)
            n += 1
            for j, b in mcu:
                v = int(coefs[j][b, 0])
                if ah:
                    w.put(v >> al & 1, 1)
                else:
                    d = (v >> al) - pred[j]
                    pred[j] = v >> al
                    w.sym(FLAT, abs(d).bit_length())
                    w.val(d)
        emit([c[0] for c in comps], 0, 0, ah, al, segments + [w.done()])

    def alone(j):
        i, h, v = comps[j]
        wide, high = -(-(-(-width * h // hs)) // 8), -(-(-(-height * v // vs)) // 8)
        return [y * across * h + x for y in range(high) for x in range(wide)]

    def ac(j, lo, hi, ah, al):
        segments, w, state = [], Writer(), [0, []]
        for n, b in enumerate(alone(j)):
            if restart and n and n % restart == 0:
                flush(w, state)
                segments.append(w.done())
                w = Writer()
            (ac_refine if ah else ac_first)(w, coefs[j][b], lo, hi, al, state)
        flush(w, state)
        emit([comps[j][0]], lo, hi, ah, al, segments + [w.done()])

    dc(0, 1)
    for j in range(len(comps)):
        ac(j, 1, 5, 0, 2)
        ac(j, 6, 63, 0, 2)
        ac(j, 1, 63, 2, 1)
    dc(1, 0)
    for j in range(len(comps)):
        ac(j, 1, 63, 1, 0)
    return b"".join([*out, b"\xff\xd9"])


def test_any_progressive_file():
    r = np.random.default_rng(9)
    for width, height, comps, restart in ((40, 24, [(1, 2, 2), (2, 1, 1), (3, 1, 1)], 0), (17, 50, [(1, 2, 1), (2, 1, 1), (3, 1, 1)], 2), (33, 9, [(1, 1, 1)], 0), (64, 64, [(1, 1, 1)], 3), (16, 16, [(7, 1, 1), (8, 1, 1), (9, 1, 1)], 0)):
        hs, vs = max(c[1] for c in comps), max(c[2] for c in comps)
        across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
        coefs = []
        for _, h, v in comps:
            c = np.where(r.random((across * h * down * v, 64)) < 0.15, r.integers(-90, 91, (across * h * down * v, 64)), 0)
            c[r.random(len(c)) < 0.3, 1:] = 0
            coefs.append(c)
        image = J.decode(write(width, height, comps, coefs, restart))
        assert (image.width, image.height) == (width, height)
        for p, want in zip(image.parts, coefs, strict=True):
            ys, xs = np.divmod(np.arange(len(want)), p.row)
            inside = (ys < p.high) & (xs < p.wide)
            assert (p.coef[:, 0] == want[:, 0])[inside | (len(comps) > 1)].all()
            assert (p.coef[inside] == want[inside]).all()
        assert J.rgb(image).shape == (height, width, 3)


def test_transform_and_colour():
    image = J.decode(J.encode_bytes(bytes(range(256)) * 9))
    r = np.random.default_rng(3)
    for p in image.parts:
        p.coef = r.integers(-60, 60, p.coef.shape)
    got = J.rgb(image)
    planes = []
    for p in image.parts:
        plane = np.zeros((p.high * 8, p.row * 8))
        for b, coef in enumerate(p.coef):
            grid = np.zeros(64)
            grid[J.zigzag()] = coef
            f = grid.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = sum((0.5 ** 0.5 if u == 0 else 1) * (0.5 ** 0.5 if v == 0 else 1) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
                    plane[b // p.row * 8 + y, b % p.row * 8 + x] = np.clip(np.rint(s + 128), 0, 255)
            if b >= 2:
                break
        planes.append(plane)
    y, cb, cr = planes[0][:8, :16], planes[1][:4, :8].repeat(2, 0).repeat(2, 1), planes[2][:4, :8].repeat(2, 0).repeat(2, 1)
    want = np.stack((y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)), 2).clip(0, 255)
    assert np.abs(got[:8, :16].astype(float) - want).max() <= 2


def test_store_round_trip_and_fast_path_equals_serial(monkeypatch):
    r = random.Random(1)
    for n in (1, 2, 3, 40):
        payload = bytes(r.randrange(256) for _ in range(576 * n))
        media = J.encode_bytes(payload)
        image = J.decode(media)
        assert J.stored_bytes(image, len(payload)) == payload
        if n < 4:
            with monkeypatch.context() as m:
                m.setattr(J.Huffman, "window", lambda self, ac: None)
                m.setattr(J, "windows", lambda data, n, count, first=0: None if n != 1 or first else np.unpackbits(np.frombuffer(data, np.uint8))[:count])
                serial = J.decode(media)
            assert all((a.coef == b.coef).all() for a, b in zip(image.parts, serial.parts, strict=True))


def test_columns(spark):
    texts = ["", None, "abc", "é" * 300, "x" * 576, "x" * 577, "long " * 60000]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(2, "abc", "z"), (None, "abc", "z")]
    got = J.media_columns(spark.createDataFrame(rows, "doc_id long, text string, feature string"), tensors=True).collect()
    assert len(got) == len(rows)
    for row, (doc, text, _) in zip(sorted(got, key=lambda x: (x.doc_id is None, x.doc_id or 0, x.n_bytes)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (row.doc_id, row.n_bytes, row.payload_bytes) == (doc, len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-32:])
        assert row.media_bytes == len(row.media) and row.media_sha256 == hashlib.sha256(row.media).hexdigest()
        assert len(row.rgb) == row.height * row.width * 3
    assert len({(x.media_sha256, x.feature) for x in got if x.n_bytes == 3}) == 1
    assert J.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0
