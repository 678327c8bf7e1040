"""Vectorised text helpers for Arrow batches: words, word hashes, distinct shingle sets.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are
lower-cased. Everything works on whole texts; a long text is hashed in pieces cut
at word ends, so scratch memory is bounded by ``PIECE`` and not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18          # bytes hashed at once
BATCH = 1 << 20          # bytes of text handled together
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inv):
            p = np.full(size, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch: ``hash``, byte ``start``/``end`` (within the batch), ``off``: first word of each text.

    ``fold``: A-Z hash as a-z.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, separators: np.ndarray = _SEP, fold: bool = True):
        n, codes = len(data), _CODE_LOWER if fold else _CODE
        sep = separators[data]
        word = ~sep
        first = word.copy()
        first[1:] &= sep[:-1]
        last = word.copy()
        last[:-1] &= sep[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, off)
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            lo, hi = self.start[i], self.end[j - 1]
            pw, inv = _powers(hi - lo + 1)
            h = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(codes[data[lo:hi]] * pw[:hi - lo], out=h[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            self.hash[i:j] = mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64))
            i = j

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and the number of words left in its text from there."""
        n = len(self.hash)
        left = np.repeat(self.off[1:], np.diff(self.off)) - np.arange(n)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            part = mix(self.hash[j:] + _CODE[j])
            h[:n - j] += part * np.uint64(2 * j + 1)
        return mix(h), left


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BATCH bytes of text (one text at least)."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BATCH, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text.

    Fewer than k words: the whole sequence is one shingle. No words: an empty set.
    """
    data, off = text_buffers(col)
    w = Words(data, off)
    h, _ = w.shingles(k)
    for i in range(len(off) - 1):
        a, b = w.off[i], w.off[i + 1]
        if b - a >= k:
            yield np.unique(h[a:b - k + 1])
        elif b > a:
            part = w.hash[a:b] * (np.arange(b - a, dtype=np.uint64) * np.uint64(2) + np.uint64(3))
            yield mix(np.append(part, np.uint64(b - a)).sum(dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)
