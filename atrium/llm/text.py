"""Batch kernels over UTF-8 text shared by the operators of this subpackage.

Everything here works on a whole Arrow batch at once: the texts of a batch lie
in one byte buffer with document offsets, and word boundaries, word hashes and
window hashes are computed with a handful of numpy passes.  A word is a run of
bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; bounds the memory of a task and stays in the processor's cache.
SLICE = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, SLICE + 65536)
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        up, down = np.full(n, base), np.full(n, inverse)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = base**i times the polynomial hash of buf[i:j]."""
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * powers(len(buf))[0][: len(buf)], out=s[1:])
    return s


def spans_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), equal for equal bytes."""
    return mix((s[end] - s[start]) * powers(len(s))[1][start])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and the rows' offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * size).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def doc_slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _word_bounds(buf: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf; a document's edge ends a word."""
    word = ~gap[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a batch of texts.

    start, end: byte positions in buf; hash: 64-bit hash of each word's bytes;
    of: index of the first word of each document (n + 1 entries).  gap: which
    byte values stand between words.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, gap: np.ndarray = SPACE):
        self.buf, self.off = (LOWER[buf] if lower else buf), off
        starts, ends, hashes = [], [], []
        for i, j in doc_slices(off):
            a, b = int(off[i]), int(off[j])
            while a < b:
                stop = b
                if b - a > 2 * SLICE:  # part of one very long text, cut between words
                    stop = a + SLICE
                    while stop < b and not (space := np.flatnonzero(gap[self.buf[stop : stop + SLICE]])).size:
                        stop = min(b, stop + SLICE)
                    stop = stop + int(space[0]) if stop < b else b
                piece = self.buf[a:stop]
                edges = np.clip(off[i : j + 1] - a, 0, len(piece))
                s, e = _word_bounds(piece, edges, gap)
                hashes.append(spans_hash(prefix_hash(piece), s, e))
                starts.append(s + a)
                ends.append(e + a)
                a = stop
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end, self.hash = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
        self.of = np.searchsorted(self.start, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of the k-word windows of an array of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = powers(k + 1)[0]
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * up[i + 1]
    return mix(total)
