"""Baseline JPEG: gray or colour, Huffman coded, any sampling, restart intervals, comments."""

from __future__ import annotations

import struct

import numpy as np

Raster = tuple[np.ndarray, int]

# The order of coefficients, the standard's example tables for quantisation (luminance, colour) and for
# Huffman codes (numbers of codes by length, and symbols).
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
DC_SIZES, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
AC_SIZES = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_SYMBOLS = [
    1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177,
    193, 21, 82, 209, 240, 36, 51, 98, 114, 130, 9, 10, 22, 23, 24, 25, 26, 37, 38, 39, 40, 41, 42, 52, 53, 54, 55,
    56, 57, 58, 67, 68, 69, 70, 71, 72, 73, 74, 83, 84, 85, 86, 87, 88, 89, 90, 99, 100, 101, 102, 103, 104, 105, 106,
    115, 116, 117, 118, 119, 120, 121, 122, 131, 132, 133, 134, 135, 136, 137, 138, 146, 147, 148, 149, 150, 151, 152, 153, 154, 162, 163,
    164, 165, 166, 167, 168, 169, 170, 178, 179, 180, 181, 182, 183, 184, 185, 186, 194, 195, 196, 197, 198, 199, 200, 201, 202, 210, 211,
    212, 213, 214, 215, 216, 217, 218, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 241, 242, 243, 244, 245, 246, 247, 248, 249, 250,
]
_K = np.arange(8)
_DCT = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


def _codes(sizes: list[int]) -> list[tuple[int, int]]:
    """The canonical codes: (code, length) of each symbol."""
    out, code = [], 0
    for length, n in enumerate(sizes, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _table(quality: int, base: list[int]) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray) -> np.ndarray:
    """[rows, columns, 8, 8] of a plane whose sides are multiples of 8."""
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write(a: np.ndarray, depth: int = 8, quality: int = 75, halve: bool = True, comment: str = "") -> bytes:
    """A JPEG of a gray (8 bits or fewer) or r, g, b raster. halve: colour at half the size each way."""
    if a.ndim == 2:
        planes, steps = [a.astype(np.float64) * (255 // ((1 << depth) - 1) if depth < 8 else 1)], [1]
    else:
        r, g, b = (a[:, :, k].astype(np.float64) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes, steps = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], [1, 2, 2] if halve else [1, 1, 1]
    h, w = a.shape[:2]
    unit = 8 * max(steps)
    tables = [_table(quality, LUMINANCE), _table(quality, COLOUR)]
    made = []
    for plane, step in zip(planes, steps, strict=True):
        p = np.pad(plane, ((0, -h % unit), (0, -w % unit)), mode="edge")
        if step == 2:
            p = p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3))
        c = _DCT @ (_blocks(p) - 128) @ _DCT.T
        q = np.rint(c.reshape(*c.shape[:2], 64) / tables[len(made) > 0]).astype(int)
        made.append(q[:, :, ZIGZAG])
    dc, ac = (dict(zip(s, _codes(n), strict=True)) for s, n in ((DC_SYMBOLS, DC_SIZES), (AC_SYMBOLS, AC_SIZES)))
    bits: list[str] = []

    def put(code: tuple[int, int]) -> None:
        bits.append(format(code[0], f"0{code[1]}b"))

    def put_value(v: int, size: int) -> None:
        if size:
            bits.append(format(v if v > 0 else v + (1 << size) - 1, f"0{size}b"))

    last = [0] * len(made)
    big = max(steps)
    rows, columns = (made[0].shape[k] // (big // steps[0]) for k in (0, 1))
    for my in range(rows):
        for mx in range(columns):
            for k, (blocks, step) in enumerate(zip(made, steps, strict=True)):
                n = big // step
                for block in (blocks[my * n + j, mx * n + i] for j in range(n) for i in range(n)):
                    v = block.tolist()
                    diff, last[k] = v[0] - last[k], v[0]
                    size = abs(diff).bit_length()
                    put(dc[size]), put_value(diff, size)
                    run = 0
                    end = max((i for i in range(1, 64) if v[i]), default=0)
                    for x in v[1 : end + 1]:
                        if not x:
                            run += 1
                            continue
                        while run > 15:
                            put(ac[0xF0])
                            run -= 16
                        size = abs(x).bit_length()
                        put(ac[run << 4 | size]), put_value(x, size)
                        run = 0
                    if end < 63:
                        put(ac[0])
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") if text else b""
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    if comment:
        out += _segment(0xFE, comment.encode())
    out += b"".join(_segment(0xDB, bytes([k]) + bytes(tables[k][ZIGZAG].tolist())) for k in range(min(2, len(made))))
    out += _segment(0xC0, struct.pack(">BHHB", 8, h, w, len(made)) + b"".join(bytes([k + 1, (big // s) << 4 | big // s, int(k > 0)]) for k, s in enumerate(steps)))
    out += _segment(0xC4, b"\x00" + bytes(DC_SIZES) + bytes(DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_SIZES) + bytes(AC_SYMBOLS))
    out += _segment(0xDA, bytes([len(made)]) + b"".join(bytes([k + 1, 0]) for k in range(len(made))) + b"\0\x3f\0")
    return out + data + b"\xff\xd9"


def _segments(data: bytes):
    """Markers with their bodies, up to the scan, whose body is followed by the place of its data."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        at += 2 + n
        if marker == 0xDA:
            return


def header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and channels, without decoding."""
    for marker, body, _ in _segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            bits, h, w, n = struct.unpack(">BHHB", body[:6])
            return w, h, bits, n
    raise ValueError("no frame")


def comment(data: bytes) -> str:
    return next((body.decode("latin-1") for marker, body, _ in _segments(data) if marker == 0xFE), "")


def _lookup(sizes: list[int], symbols: list[int]) -> tuple[list[int], list[int]]:
    """Symbol and length for every 16 bits that may come."""
    symbol, length = [0] * 65536, [0] * 65536
    for s, (code, n) in zip(symbols, _codes(sizes), strict=False):
        a, e = code << (16 - n), (code + 1) << (16 - n)
        symbol[a:e], length[a:e] = [s] * (e - a), [n] * (e - a)
    return symbol, length


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\0", b"\xff") + bytes(8), 0

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 4], "big") >> (16 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        x = self.peek()
        n = table[1][x]
        if not n or self.at > 8 * len(self.data):
            raise ValueError("broken code")
        self.at += n
        return table[0][x]

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.peek() >> (16 - size)
        self.at += size
        return v if v >> (size - 1) else v - (1 << size) + 1


def _scans(data: bytes) -> list[bytes]:
    """The entropy-coded data up to the next other marker, cut at restart markers."""
    out, at = [], 0
    while True:
        e = data.find(b"\xff", at)
        while e >= 0 and e + 1 < len(data) and data[e + 1] == 0:
            e = data.find(b"\xff", e + 2)
        if e < 0 or e + 1 >= len(data):
            return [*out, data[at:]]
        out.append(data[at:e])
        if not 0xD0 <= data[e + 1] <= 0xD7:
            return out
        at = e + 2


def read(data: bytes) -> Raster:
    """The raster of a baseline JPEG. Colours at a lower sampling are repeated; progressive and four-channel files are refused."""
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, tuple] = {}
    parts, every, frame = [], 0, None
    for marker, body, after in _segments(data):
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                t = np.zeros(64)
                t[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                quant[k], body = t, body[1 + n :]  # noqa: PLW2901
        elif marker in (0xC0, 0xC1):
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            frame = h, w, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xC4:
            while body:
                sizes = list(body[1:17])
                huff[body[0]], body = _lookup(sizes, list(body[17 : 17 + sum(sizes)])), body[17 + sum(sizes) :]  # noqa: PLW2901
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            parts = _scans(data[after:])
    if frame is None or not parts or len(frame[2]) not in (1, 3):
        raise ValueError("no gray or three-channel frame")
    h, w, channels = frame
    if len(channels) == 1:
        channels = [(channels[0][0], 1, 1, channels[0][3])]
    top_h, top_v = max(c[1] for c in channels), max(c[2] for c in channels)
    columns, rows = -(-w // (8 * top_h)), -(-h // (8 * top_v))
    every = every or rows * columns
    blocks = [np.zeros((rows * v, columns * hs, 64), np.int64) for _, hs, v, _ in channels]
    for k, part in enumerate(parts):
        bits, last = _Bits(part), [0] * len(channels)
        for unit in range(k * every, min((k + 1) * every, rows * columns)):
            my, mx = divmod(unit, columns)
            for c, (ident, hs, v, _) in enumerate(channels):
                dc, ac = huff[chosen[ident] >> 4], huff[0x10 | chosen[ident] & 15]
                for j in range(v):
                    for i in range(hs):
                        last[c] += bits.value(bits.symbol(dc))
                        block = blocks[c][my * v + j, mx * hs + i]
                        block[0] = last[c]
                        at = 1
                        while at < 64:
                            s = bits.symbol(ac)
                            if not s & 15:
                                if s != 0xF0:
                                    break
                                at += 16
                                continue
                            at += s >> 4
                            if at > 63:
                                raise ValueError("broken block")
                            block[ZIGZAG[at]] = bits.value(s & 15)
                            at += 1
    planes = []
    for b, (_, hs, v, q) in zip(blocks, channels, strict=True):
        c = (b * quant[q]).reshape(*b.shape[:2], 8, 8)
        p = (_DCT.T @ c @ _DCT + 128).transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8)
        planes.append(np.repeat(np.repeat(p, top_v // v, axis=0), top_h // hs, axis=1)[:h, :w])
    whole = lambda x: np.clip(np.rint(x), 0, 255).astype(np.uint8)
    if len(planes) == 1:
        return whole(planes[0]), 8
    y, cb, cr = planes
    cb, cr = cb - 128, cr - 128
    return np.stack([whole(y + 1.402 * cr), whole(y - 0.344136 * cb - 0.714136 * cr), whole(y + 1.772 * cb)], axis=2), 8
