"""MPEG audio columns: frame headers, tags, variable-bitrate tables, checksums, durations and seek offsets.

`parse` reads any MPEG-1/2/2.5 layer I-III stream. `store` lays a payload of bytes losslessly into a stream of
silent layer-III frames (the bytes travel as ancillary data, which decoders skip), and `payload_of` reads it back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.llm.words import slices

UNIT = 192
# Fixed values of the MPEG audio format: kbit/s by (MPEG-1?, layer), Hz by version.
_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    hz: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(4096)
def header(word: int) -> Header | None:
    """The frame header in four bytes, or None where they are none (free-format streams count as none)."""
    if word >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate, hz = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or rate in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    kbit, hz, pad = _RATES[version == 1, layer][rate], _HZ[version][hz], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbit // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hz + pad
    return Header(version, layer, not word >> 16 & 1, kbit, hz, word >> 6 & 3 == 3, size, samples)


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The format's checksum (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass
class Stream:
    """What a stream holds. offsets: each audio frame's first byte. seconds: exact."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    seconds: Fraction = Fraction(0)
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    toc: bytes = b""
    checked: int = 0
    bad: int = 0
    skipped: int = 0


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    tags, at, end = {}, 10, min(10 + size, len(data))
    while at + 10 <= end and data[at : at + 4].isalnum():
        four = data[at + 4 : at + 8]
        n = sum((b & 0x7F) << s for b, s in zip(four, (21, 14, 7, 0), strict=True)) if data[3] == 4 else int.from_bytes(four, "big")
        body = data[at + 10 : at + 10 + n]
        if data[at : at + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0")
            tags[key if data[at : at + 4] == b"TXXX" else data[at : at + 4].decode()] = (value if data[at : at + 4] == b"TXXX" else text).rstrip("\0")
        at += 10 + n
    return end + (10 if data[5] & 0x10 else 0), tags


def _table(data: bytes, at: int, h: Header) -> tuple[str, int, int, bytes]:
    """A Xing/Info or VBRI table in a frame."""
    x = at + 4 + 2 * h.protected + h.side
    if (name := data[x : x + 4]) in (b"Xing", b"Info"):
        flags, p, frames, size, toc = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, -1, -1, b""
        if flags & 1:
            frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            size, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            toc = data[p : p + 100]
        return name.decode(), frames, size, toc
    if data[at + 36 : at + 40] == b"VBRI" and at + 54 <= len(data):
        size, frames = struct.unpack(">II", data[at + 46 : at + 54])
        return "VBRI", frames, size, b""
    return "", -1, -1, b""


def parse(data: bytes) -> Stream:
    """Walk a stream frame by frame; where a header doesn't hold, go on to the next place where two in a row do.

    Empty data, and data without a frame, give a stream of no frames and duration 0.
    """
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    start, synced, first = at, False, True
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h is not None and at + h.size <= end and not synced:
            after = at + h.size
            if after + 4 <= end and header(int.from_bytes(data[after : after + 4], "big")) is None:
                h = None
        if h is None or at + h.size > end:
            synced = False
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        out.skipped += at - start
        if h.protected and h.layer == 3:
            out.checked += 1
            out.bad += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first and h.layer == 3:
            out.table, out.table_frames, out.table_bytes, out.toc = _table(data, at, h)
        if not (first and out.table):
            out.offsets.append(at)
            out.headers.append(h)
        first, synced = False, True
        at = start = at + h.size
    out.skipped += max(0, end - start)
    by_hz: dict[int, int] = {}
    for h in out.headers:
        by_hz[h.hz] = by_hz.get(h.hz, 0) + h.samples
    out.seconds = sum((Fraction(n, hz) for hz, n in by_hz.items()), Fraction(0))
    return out


# The frames that `store` writes: MPEG-1 layer III, checksum, 48 kHz stereo; 80 kbit/s (240 bytes) with 192 bytes of payload.
_WORD = 0xFFFA6400
_HEAD = struct.pack(">I", _WORD)
_BODY = 4 + 2 + 32
_PREFIX = _HEAD + struct.pack(">H", crc16(_HEAD[2:] + bytes(32))) + bytes(32)
_FRAME = 240


def store(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds payload, a multiple of 192 bytes, and its unpadded length as a tag."""
    text = b"\x03n_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(tag)
    frames = len(payload) // UNIT
    total = (frames + 1) * _FRAME
    toc = bytes(min(255, 256 * (_FRAME + p * frames // 100 * _FRAME) // total) for p in range(100))
    info = _PREFIX + b"Info" + struct.pack(">III", 7, frames, total) + toc
    parts = [b"ID3\x03\x00\x00" + bytes(size >> s & 0x7F for s in (21, 14, 7, 0)) + tag, info.ljust(_FRAME, b"\0")]
    for k in range(frames):
        chunk = payload[k * UNIT : (k + 1) * UNIT]
        parts.append(_PREFIX + chunk + struct.pack(">II", zlib.crc32(chunk), k & 0xFFFFFFFF) + b"\0\0")
    return b"".join(parts)


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The payload that `store` laid into data; raises ValueError where a checksum fails."""
    parts = []
    for k, at in enumerate(stream.offsets):
        chunk = data[at + _BODY : at + _BODY + UNIT]
        crc, seq = struct.unpack(">II", data[at + _BODY + UNIT : at + _BODY + UNIT + 8])
        if zlib.crc32(chunk) != crc or seq != k & 0xFFFFFFFF:
            raise ValueError(f"frame {k} is damaged")
        parts.append(chunk)
    if stream.bad or stream.table_frames != len(parts):
        raise ValueError("damaged stream")
    return b"".join(parts)


#: The columns that media_columns can give, beside the id: name, Spark type, Arrow type.
COLUMNS = {
    "n_bytes": ("long", pa.int64()),
    "media": ("binary", pa.binary()),
    "payload": ("binary", pa.binary()),
    "frames": ("int", pa.int32()),
    "seconds_num": ("long", pa.int64()),
    "seconds_den": ("long", pa.int64()),
    "seek_offsets": ("array<long>", pa.list_(pa.int64())),
    "vbr_table": ("string", pa.string()),
    "checksums_ok": ("int", pa.int32()),
    "feature": ("string", pa.string()),
    "payload_bytes": ("long", pa.int64()),
    "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("long", pa.int64()),
    "media_bytes": ("long", pa.int64()),
    "media_sha256": ("string", pa.string()),
}


def media_columns(docs: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an MPEG stream, parsed again: one row per row of docs, with the id and the chosen columns.

    Null and empty texts give one frame of spaces. Other columns of docs are ignored; repeated rows give repeated rows.
    n_bytes: of the UTF-8 text. media: the stored stream. payload: as read back from it, a positive multiple of 192
    bytes. frames, seconds_num / seconds_den (exact duration), seek_offsets (each audio frame's first byte), vbr_table,
    checksums_ok (frames whose checksum holds), feature (these in one text), and lengths and digests of media and payload.
    """
    kind = docs.schema[id_col].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            out: dict[str, list] = {c: [] for c in columns}
            for raw in b.column(1).cast(pa.large_binary()).fill_null(b""):
                raw = raw.as_py()
                media = store(raw + b" " * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0), len(raw))
                s = parse(media)
                back = payload_of(media, s)
                feature = f"frames={len(s.offsets)};seconds={s.seconds};table={s.table}:{s.table_frames}:{s.table_bytes};crc={s.checked - s.bad}/{s.checked};skipped={s.skipped};toc50={s.toc[50]};n_bytes={s.tags.get('n_bytes')}"
                made = {
                    "n_bytes": len(raw),
                    "media": media,
                    "payload": back,
                    "frames": len(s.offsets),
                    "seconds_num": s.seconds.numerator,
                    "seconds_den": s.seconds.denominator,
                    "seek_offsets": s.offsets,
                    "vbr_table": s.table,
                    "checksums_ok": s.checked - s.bad,
                    "feature": feature,
                    "payload_bytes": len(back),
                    "payload_sha256": hashlib.sha256(back).hexdigest(),
                    "tail_crc32": zlib.crc32(back[-16:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                }
                for c in columns:
                    out[c].append(made[c])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[c], COLUMNS[c][1]) for c in columns)], names=[id_col, *columns])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(rows, ", ".join([f"`{id_col}` {kind.simpleString()}", *(f"{c} {COLUMNS[c][0]}" for c in columns)]))
