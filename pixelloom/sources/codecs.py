"""Raster formats in bytes: PNM (P1-P6), PAM (P7), BMP, PNG, GIF, SPIX, and uncompressed, PackBits, LZW or deflate TIFF.

A raster is (array, depth): an array of shape (h, w) with unsigned values of 1, 2, 4, 8 or 16 bits, or (h, w, 3) or
(h, w, 4) of 8 bits. One byte string in, one out: the readers and writers run in Arrow functions over binary columns.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib

import numpy as np

from pixelloom.sources import jpeg

Raster = tuple[np.ndarray, int]

#: First bytes of the formats that can be told apart.
MAGIC = [
    ("png", b"\x89PNG\r\n\x1a\n"), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF87a"), ("gif", b"GIF89a"), ("tiff", b"II*\x00"), ("tiff", b"MM\x00*"), ("jp2", b"\x00\x00\x00\x0cjP  "),
    ("j2k", b"\xff\x4f\xff\x51"), ("spix", b"spix"), ("bmp", b"BM"), ("pdf", b"%PDF-"), ("ps", b"%!"),
]


def sniff(data: bytes) -> str:
    """The format's name from the first bytes, or 'unknown'."""
    for name, head in MAGIC:
        if data.startswith(head):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return "pnm" if re.match(rb"P[1-7]\s", data[:3]) else "unknown"


def _unpack(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Values of 1, 2, 4 or 8 bits, most significant first, from rows of bytes."""
    if bits == 8:
        return rows[:, :width]
    flat = np.unpackbits(rows, axis=1).reshape(rows.shape[0], -1, bits)[:, :width]
    return flat @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)


def _pack(a: np.ndarray, bits: int) -> np.ndarray:
    if bits == 8:
        return a.astype(np.uint8)
    split = (a[:, :, None].astype(np.uint8) >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(split.reshape(a.shape[0], -1), axis=1)


def read_pnm(data: bytes) -> Raster:
    if data[:2] == b"P7":
        head, _, body = data.partition(b"ENDHDR\n")
        field = {k: v for k, v in re.findall(rb"^(\w+) (\S+)", head, re.M)}
        w, h, d, top = (int(field[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        a = np.frombuffer(body, ">u2" if top > 255 else np.uint8, w * h * d).reshape(h, w, d)
        return (a[:, :, 0] if d == 1 else a), 1 if top == 1 else 16 if top > 255 else 8
    kind = data[1] - 48
    fields, at = [], 2
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = [*fields, 1][:3]
    if kind == 1:
        a = np.frombuffer(re.sub(rb"#[^\n]*\n|[^01]", b"", data[at:]), np.uint8)[: w * h] - 48
        return a.reshape(h, w), 1
    if kind in (2, 3):
        a = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[: w * h * (3 if kind == 3 else 1)], np.int64)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        return _unpack(rows, w, 1), 1
    else:
        a = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * (3 if kind == 6 else 1), at + 1)
    depth = next(d for d in (1, 2, 4, 8, 16) if top < 1 << d) if kind in (2, 5) else 8
    return a.reshape((h, w, 3) if kind in (3, 6) else (h, w)), depth


def write_pnm(a: np.ndarray, depth: int, text: bool = False) -> bytes:
    h, w = a.shape[:2]
    top = (1 << depth) - 1
    if a.ndim == 3 and a.shape[2] == 4:
        return b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" % (w, h) + a.astype(np.uint8).tobytes()
    kind = (3 if a.ndim == 3 else 1 if depth == 1 else 2) + (0 if text else 3)
    head = b"P%d\n%d %d\n" % (kind, w, h) + (b"" if depth == 1 else b"%d\n" % top)
    if text:
        return head + b"\n".join(b" ".join(b"%d" % v for v in row.ravel()) for row in a) + b"\n"
    return head + (_pack(a, 1).tobytes() if depth == 1 else a.astype(">u2" if depth == 16 else np.uint8).tobytes())


def read_bmp(data: bytes) -> Raster:
    start, size, w, h = struct.unpack("<IIii", data[10:26])
    bits, colours = struct.unpack("<H", data[28:30])[0], struct.unpack("<I", data[46:50])[0]
    row = (w * bits + 31) // 32 * 4
    a = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    a = a[::-1] if h > 0 else a
    if bits >= 24:
        return np.ascontiguousarray(a[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, [2, 1, 0, *([3] if bits == 32 else [])]]), 8
    a = _unpack(a, w, bits)
    n = colours or 1 << bits
    map_ = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
    ramp = np.arange(n) * 255 // max(1, (1 << bits) - 1)
    if (map_ == ramp[:, None]).all():
        return a, bits
    if bits == 1 and (map_ == ramp[::-1, None]).all():
        return 1 - a, bits
    return map_[a], 8


def write_bmp(a: np.ndarray, depth: int) -> bytes:
    h, w = a.shape[:2]
    bits = 8 * a.shape[2] if a.ndim == 3 else {2: 4, 16: 8}.get(depth, depth)
    rows = a[:, :, [2, 1, 0, *range(3, a.shape[2])]].reshape(h, -1) if a.ndim == 3 else _pack(a >> 8 if depth == 16 else a, bits)
    rows = np.pad(rows.astype(np.uint8), ((0, 0), (0, -rows.shape[1] % 4)))[::-1].tobytes()
    n = 0 if a.ndim == 3 else 1 << bits
    map_ = b"".join(bytes([k * 255 // (n - 1)] * 3 + [0]) for k in range(n))
    start = 54 + len(map_)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(rows), 0, 0, start, 40, w, h, 1, bits, 0, len(rows), 0, 0, n, 0) + map_ + rows


def _unfilter(raw: np.ndarray, h: int, row: int, step: int) -> np.ndarray:
    out = np.zeros((h + 1, row + step), np.int32)
    lines = raw.reshape(h, row + 1)
    for y in range(h):
        kind, line, up = int(lines[y, 0]), lines[y, 1:].astype(np.int32), out[y]
        cur = out[y + 1]
        if kind == 0:
            cur[step:] = line
        elif kind == 2:
            cur[step:] = (line + up[step:]) & 255
        elif kind == 1:
            for s in range(step):
                cur[step + s :: step] = np.cumsum(line[s::step]) & 255
        else:
            for x in range(row):
                a, b, c = int(cur[x]), int(up[x + step]), int(up[x])
                if kind == 3:
                    p = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[x + step] = (line[x] + p) & 255
    return out[1:, step:].astype(np.uint8)


def read_png(data: bytes) -> Raster:
    at, body, map_, alpha = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            w, h, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            map_ = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if laced:
        raise ValueError("interlaced")
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    row, step = (w * per * bits + 7) // 8, max(1, per * bits // 8)
    a = _unfilter(np.frombuffer(zlib.decompress(b"".join(body)), np.uint8), h, row, step)
    a = a.reshape(h, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16) if bits == 16 else _unpack(a, w * per, bits)
    a = a.reshape(h, w, per)
    if colour == 3:
        full = np.concatenate([map_, np.frombuffer((alpha or b"").ljust(len(map_), b"\xff"), np.uint8)[: len(map_), None]], axis=1)
        return full[a[:, :, 0]][:, :, : 4 if alpha else 3], 8
    if colour == 4:
        a = a[:, :, [0, 0, 0, 1]]
    return (a[:, :, 0], bits) if per == 1 else (a if bits == 8 else a >> 8, 8)


def write_png(a: np.ndarray, depth: int) -> bytes:
    h, w = a.shape[:2]
    colour = {2: 0, 3: 2, 4: 6}[a.ndim if a.ndim == 2 else a.shape[2]]
    rows = a.astype(np.uint8).reshape(h, -1) if a.ndim == 3 else a.astype(">u2").view(np.uint8).reshape(h, -1) if depth == 16 else _pack(a, depth)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 if a.ndim == 3 else depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_spix(data: bytes) -> Raster:
    w, h, depth, words, colours = struct.unpack("<5I", data[4:24])
    at = 24 + 4 * colours + 4
    a = np.frombuffer(data, "<u4", words * h, at).reshape(h, words)
    if depth == 32:
        b = a.astype(">u4").view(np.uint8).reshape(h, words, 4)
        return b[:, :w, :3], 8
    if depth == 16:
        return a.astype(">u4").view(">u2").reshape(h, -1)[:, :w].astype(np.uint16), 16
    a = _unpack(a.astype(">u4").view(np.uint8).reshape(h, -1), w, depth)
    if colours:
        return np.frombuffer(data, np.uint8, 4 * colours, 24).reshape(-1, 4)[:, :3][a], 8
    return a, depth


def write_spix(a: np.ndarray, depth: int) -> bytes:
    h, w = a.shape[:2]
    if a.ndim == 3:
        full = np.full((h, w, 4), 255, np.uint8)
        full[:, :, : a.shape[2]] = a
        rows, depth = full.reshape(h, -1), 32
    else:
        rows = a.astype(">u2").view(np.uint8).reshape(h, -1) if depth == 16 else _pack(a, depth)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    raster = rows.view(">u4").astype("<u4").tobytes()
    return b"spix" + struct.pack("<6I", w, h, depth, rows.shape[1] // 4, 0, len(raster)) + raster


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _codes(data: bytes, high_first: bool):
    """A reader of codes of a given number of bits; None at the end."""
    held, bits, at = 0, 0, 0

    def take(n: int) -> int | None:
        nonlocal held, bits, at
        while bits < n:
            if at == len(data):
                return None
            held = held << 8 | data[at] if high_first else held | data[at] << bits
            bits, at = bits + 8, at + 1
        bits -= n
        if high_first:
            out, held = held >> bits, held & (1 << bits) - 1
        else:
            out, held = held & (1 << n) - 1, held >> n
        return out

    return take


def lzw_decode(data: bytes, root_bits: int = 8, high_first: bool = True) -> bytes:
    """Variable-width LZW. high_first: as in TIFF, which widens its codes one early; else as in GIF."""
    take, clear = _codes(data, high_first), 1 << root_bits
    early = int(high_first)
    out, table, width, last = bytearray(), [], root_bits + 1, None
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    while (code := take(width)) is not None and code != clear + 1:
        if code == clear:
            table, width, last = list(roots), root_bits + 1, None
            continue
        if not table:
            table = list(roots)
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + word[:1])
        out += word
        last = word
        if len(table) + early >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes, root_bits: int) -> bytes:
    """Variable-width LZW with the low bits first, as in GIF."""
    clear = 1 << root_bits
    held, bits, out = 0, 0, bytearray()

    def put(code: int, n: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += n
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    table, width = {bytes([k]): k for k in range(clear)}, root_bits + 1
    put(clear, width)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        if len(table) + 2 < 4096:
            table[longer] = len(table) + 2
            if len(table) + 1 >= (1 << width) and width < 12 and len(table) + 2 > 1 << width:
                width += 1
        else:
            put(clear, width)
            table, width = {bytes([k]): k for k in range(clear)}, root_bits + 1
        word = data[k : k + 1]
    if word:
        put(table[word], width)
    put(clear + 1, width)
    if bits:
        out.append(held & 255)
    return bytes(out)


def read_gif(data: bytes) -> Raster:
    """The one frame of a GIF; several frames are an error. A gray ramp as palette gives gray."""
    flags, at = data[10], 13
    map_ = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3) if flags & 0x80 else None
    at += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    found, root = bytearray(), 0
    while data[at] != 0x3B:
        frame = data[at] != 0x21
        if not frame:
            at += 2
        else:
            if root:
                raise ValueError("several frames")
            w, h, local = struct.unpack("<HHB", data[at + 5 : at + 10])
            at += 10
            if local & 0x40:
                raise ValueError("interlaced")
            if local & 0x80:
                map_ = np.frombuffer(data, np.uint8, 3 << (local & 7) + 1, at).reshape(-1, 3)
                at += 3 << (local & 7) + 1
            root = data[at]
            at += 1
        while data[at]:
            if frame:
                found += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
    a = np.frombuffer(lzw_decode(bytes(found), root, False), np.uint8)[: w * h].reshape(h, w)
    n = len(map_)
    if (map_ == (np.arange(n) * 255 // (n - 1))[:, None]).all():
        return a, (n - 1).bit_length()
    return map_[a], 8


def write_gif(a: np.ndarray, depth: int) -> bytes:
    """Gray of up to 8 bits, or colour of up to 256 different colours."""
    h, w = a.shape[:2]
    if a.ndim == 3:
        map_, index = np.unique(a.reshape(-1, a.shape[2])[:, :3], axis=0, return_inverse=True)
        if len(map_) > 256:
            raise ValueError("more than 256 colours")
        bits = max(1, (len(map_) - 1).bit_length())
    else:
        bits = min(depth, 8)
        map_, index = np.repeat(np.arange(1 << bits)[:, None] * 255 // ((1 << bits) - 1), 3, axis=1), (a >> 8 if depth == 16 else a).ravel()
    map_ = np.pad(map_.astype(np.uint8), ((0, (1 << bits) - len(map_)), (0, 0)))
    root = max(2, bits)
    body = lzw_encode(index.astype(np.uint8).tobytes(), root)
    blocks = b"".join(bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | bits - 1, 0, 0) + map_.tobytes() + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([root]) + blocks + b"\0;"


def read_tiff(data: bytes, page: int = 0) -> Raster:
    """A strip image: no compression, PackBits, LZW or deflate; 1, 2, 4, 8 or 16 bits gray, or RGB(A) of 8."""
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    for _ in range(page):
        at = struct.unpack(e + "I", data[at + 2 + 12 * struct.unpack(e + "H", data[at : at + 2])[0] :][:4])[0]
        if not at:
            raise ValueError("no such page")
    tags = {}
    for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
        place = at + 10 + 12 * k if n * size <= 4 else struct.unpack(e + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        if kind in (1, 3, 4):
            tags[tag] = struct.unpack(f"{e}{n}{code}", data[place : place + n * size])
    one = lambda t, d: tags.get(t, (d,))[0]
    w, h, bits, per, how, photo = one(256, 0), one(257, 0), one(258, 1), one(277, 1), one(259, 1), one(262, 1)
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279])]
    undo = {1: bytes, 5: lzw_decode, 32773: _packbits, 8: zlib.decompress, 32946: zlib.decompress}
    if one(317, 1) not in (1, 2):
        raise ValueError("predictor")
    if how not in undo:
        raise ValueError(f"compression {how}")
    raw = np.frombuffer(b"".join(map(undo[how], strips)), np.uint8)
    row = (w * per * bits + 7) // 8
    a = raw[: row * h].reshape(h, row)
    a = a.view(e + "u2").astype(np.uint16).reshape(h, -1) if bits == 16 else _unpack(a, w * per, bits)
    if one(317, 1) == 2:  # differences to the left neighbour, channel by channel
        a = (np.cumsum(a.reshape(h, w, per).astype(np.int64), axis=1) % (1 << bits)).astype(a.dtype).reshape(h, -1)
    if per > 1:
        return a.reshape(h, w, per)[:, :, :4], 8
    return ((1 << bits) - 1 - a if photo == 0 and bits == 1 else a), bits


def write_tiff(a: np.ndarray, depth: int, deflate: bool = True) -> bytes:
    h, w = a.shape[:2]
    per = a.shape[2] if a.ndim == 3 else 1
    raw = (a.astype("<u2") if depth == 16 else a.astype(np.uint8) if a.ndim == 3 else _pack(a, depth)).tobytes()
    body = zlib.compress(raw) if deflate else raw
    bits = depth if per == 1 else 8
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, 8 if deflate else 1), (262, 3, 1, 2 if per > 1 else 1), (273, 4, 1, 8), (277, 3, 1, per), (278, 4, 1, h), (279, 4, 1, len(body))]
    body += b"\0" * (len(body) % 2)
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *x) for x in entries) + b"\0\0\0\0"


def _directories(data: bytes) -> list[int]:
    """The places of a TIFF's directories, one per page."""
    e = "<" if data[:2] == b"II" else ">"
    out, at = [], struct.unpack(e + "I", data[4:8])[0]
    while at and at not in out:
        out.append(at)
        at = struct.unpack(e + "I", data[at + 2 + 12 * struct.unpack(e + "H", data[at : at + 2])[0] :][:4])[0]
    return out


def tiff_pages(data: bytes) -> int:
    """The number of pages of a TIFF."""
    return len(_directories(data))


def write_tiff_pages(pages: list[tuple[np.ndarray, int]], deflate: bool = True) -> bytes:
    """One TIFF of several rasters."""
    out = b""
    for a, depth in pages:
        out = append_tiff(out, a, depth, deflate)
    return out


def append_tiff(data: bytes, a: np.ndarray, depth: int, deflate: bool = True) -> bytes:
    """A little-endian TIFF with one more page."""
    page = write_tiff(a, depth, deflate)
    if not data:
        return page
    shift = len(data) - 8
    at = struct.unpack("<I", page[4:8])[0]
    out = bytearray(page)
    for k in range(struct.unpack("<H", page[at : at + 2])[0]):
        place = at + 2 + 12 * k
        if struct.unpack("<H", page[place : place + 2])[0] == 273:  # where the strip starts
            out[place + 8 : place + 12] = struct.pack("<I", struct.unpack("<I", page[place + 8 : place + 12])[0] + shift)
    last = _directories(data)[-1]
    link = last + 2 + 12 * struct.unpack("<H", data[last : last + 2])[0]
    return data[:link] + struct.pack("<I", at + shift) + data[link + 4 :] + bytes(out[8:])


def header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits of a channel and channels, without decoding pixels."""
    kind = sniff(data)
    if kind == "png":
        w, h, bits, colour = struct.unpack(">IIBB", data[16:26])
        return w, h, bits, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if kind == "bmp":
        w, h = struct.unpack("<ii", data[18:26])
        bits = struct.unpack("<H", data[28:30])[0]
        return w, abs(h), min(bits, 8), max(1, bits // 8)
    if kind == "gif":
        w, h, flags = struct.unpack("<HHB", data[6:11])
        return w, h, (flags & 7) + 1, 1
    if kind == "spix":
        w, h, bits = struct.unpack("<3I", data[4:16])
        return w, h, min(bits, 16) if bits < 32 else 8, 3 if bits == 32 else 1
    if kind == "jpeg":
        return jpeg.header(data)
    if kind == "tiff":
        e, at = "<" if data[:2] == b"II" else ">", _directories(data)[0]
        tags = {}
        for k in range(struct.unpack(e + "H", data[at : at + 2])[0]):
            tag, size, n = struct.unpack(e + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            if n == 1:
                tags[tag] = struct.unpack(e + ("H" if size == 3 else "I"), data[at + 10 + 12 * k : at + 12 + 12 * k + 2 * (size != 3)])[0]
        return tags[256], tags[257], tags.get(258, 8 if tags.get(277, 1) > 1 else 1), tags.get(277, 1)
    if data[:2] == b"P7":
        field = {k: int(v) for k, v in re.findall(rb"^(WIDTH|HEIGHT|DEPTH|MAXVAL) (\d+)", data.partition(b"ENDHDR")[0], re.M)}
        return field[b"WIDTH"], field[b"HEIGHT"], field[b"MAXVAL"].bit_length(), field[b"DEPTH"]
    if kind == "pnm":
        number = data[1] - 48
        w, h, top = [int(x) for x in re.sub(rb"#[^\n]*\n", b" ", data[2:4096]).split()[: 2 if number in (1, 4) else 3]] + ([1] if number in (1, 4) else [])
        return w, h, next(d for d in (1, 2, 4, 8, 16) if top < 1 << d), 3 if number in (3, 6) else 1
    raise ValueError(f"no reader for {kind}")


def ascii85(data: bytes) -> str:
    """Five letters for four bytes ('z' for four of 0), in lines of 64, ended by '~>'."""
    text = base64.a85encode(data).decode()
    return "\n".join(text[k : k + 64] for k in range(0, len(text), 64)) + "\n~>\n"


READERS = {"gif": read_gif, "pnm": read_pnm, "bmp": read_bmp, "png": read_png, "spix": read_spix, "tiff": read_tiff, "jpeg": jpeg.read}
WRITERS = {"gif": write_gif, "pnm": write_pnm, "bmp": write_bmp, "png": write_png, "spix": write_spix, "tiff": write_tiff, "jpeg": lambda a, depth: jpeg.write(a, depth, 100, False)}


def read(data: bytes) -> Raster:
    kind = sniff(data)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return READERS[kind](data)


def base64_lines(data: bytes) -> str:
    """base64 in lines of 72 characters."""
    text = base64.b64encode(data).decode()
    return "\n".join(text[k : k + 72] for k in range(0, len(text), 72)) + "\n"
