"""Vectorised words and hashes over Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 3 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=_U)
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _M2
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """The words of some texts: byte spans [start, end) of `data`, and each text's range of words in `at`."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        raw = texts.buffers()
        offsets = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0])
        self.data = np.zeros(size + 8, np.uint8)
        if size:
            self.data[:size] = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]]
        if lower:
            self.data = _LOWER[self.data]
        self.byte_at = offsets - offsets[0]
        solid = ~_SPACE[self.data[:size]]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = self.byte_at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < size)]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, self.byte_at)

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; words of up to 8 bytes never collide with one another at equal length."""
        return self.span_hashes(self.start, self.end)

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        eight = np.ndarray((max(1, len(self.data) - 7),), np.dtype("<u8"), self.data, strides=(1,))
        length = end - start
        h = mix(eight[start] & _KEEP[np.minimum(length, 8)]) ^ (length.astype(_U) * _M1)
        todo, at = np.flatnonzero(length > 8), 8
        while len(todo):
            left = length[todo] - at
            h[todo] = mix((h[todo] * _M1) ^ (eight[start[todo] + at] & _KEEP[np.minimum(left, 8)]))
            at += 8
            todo = todo[left > 8]
        return mix(h + _M1)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def pick(self, which) -> list[bytes]:
        """The words of these numbers."""
        raw = memoryview(self.data)
        start, end = self.start[which].tolist(), self.end[which].tolist()
        return [bytes(raw[a:e]) for a, e in zip(start, end, strict=True)]

    def joined(self, which) -> tuple[bytes, np.ndarray]:
        """The words of these numbers, joined by spaces, and how many bytes each has."""
        start, size = self.start[which], self.end[which] - self.start[which]
        if not len(size):
            return b"", size
        first = np.concatenate([[0], np.cumsum(size + 1)])
        out = self.data[np.repeat(start - first[:-1], size + 1) + np.arange(int(first[-1]))]
        out[first[1:] - 1] = 0x20
        return out[:-1].tobytes(), size


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in runs of about `most` bytes of text; one text is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pa.compute.binary_length(col).fill_null(0)).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def shingles(h: np.ndarray, at: np.ndarray, n: int, whole_if_fewer: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text (h: word hashes, at: ranges), and the ranges of these.

    A text of 1 to n-1 words gives its whole sequence as one, if so wished; one without words gives none.
    """
    counts = np.diff(at)
    total = len(h)
    run = np.zeros(total, _U)
    for k in range(n):
        run[: total - k] = mix(run[: total - k] * _M1 + h[k:] + _U(k + 1)) if k < total else run[:0]
    keep = np.ones(total, bool)
    ends = at[1:]
    for k in range(1, n):
        back = ends - k
        keep[back[counts >= k]] = False
    out_counts = np.maximum(counts - n + 1, 0)
    if whole_if_fewer:
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            x = _U(counts[i])
            with np.errstate(over="ignore"):
                for w in h[at[i] : at[i + 1]]:
                    x = mix(np.array([x * _M1 + w], _U))[0]
            run[at[i]] = x
            keep[at[i]] = True
            out_counts[i] = 1
    return run[keep], np.concatenate([[0], np.cumsum(out_counts)])


def crc_mod(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo `modulus`; a null id counts as the text ''."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], np.int64)
