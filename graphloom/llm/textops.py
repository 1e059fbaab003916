"""Numpy work on Arrow batches of texts: slices of bounded size, word and line hashes, code points.

A slice is the UTF-8 bytes of consecutive rows, taken from the Arrow buffer without copying, with the
offsets of the rows; a row is never split, so that a slice is larger than asked only if one row is.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: What each operator keeps in a Python worker, by name.
_kept: dict[str, dict] = {}


def keep(name: str, cache: dict) -> dict:
    """Register a worker's cache, to be freed when another operator starts there."""
    _kept[name] = cache
    return cache


def claim(name: str) -> None:
    """Free what other operators left in this worker; workers serve one task at a time."""
    others = [c for n, c in _kept.items() if n != name and c]
    for cache in others:
        cache.clear()
    if others:
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps freed memory its own way


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null is empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets from 0)`` of each slice of a batch."""
    data, offs = column(batch, name)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The sum of ``values`` between consecutive offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


#: For 0 to 8 bytes left in a span, the bits of a word that belong to it.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes from which a span is hashed by itself.
LONG_SPAN = 512


class Hashes:
    """64-bit hashes of any spans of a slice, eight bytes of all spans at a time, each mixed in before the next.

    The mixing is not linear, so no pattern of bytes makes two spans alike but by chance; what must be exact
    is confirmed by ``equal_spans``.
    """

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        self._padded = np.concatenate((buf, np.zeros(8, np.uint8)))
        self.words = np.ndarray((len(buf) + 1,), np.dtype("<u8"), self._padded, 0, (1,))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
        if not len(size):
            return h
        for i in np.flatnonzero(size >= LONG_SPAN).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
        every = size < LONG_SPAN
        todo = np.flatnonzero(every & (size > 0))
        at, left = starts[todo], size[todo]
        while len(todo):
            x = self.words[at] & _MASKS[np.minimum(left, 8)]
            h[todo] = mix(h[todo] ^ x)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return h

    def grams(self, q: int) -> np.ndarray:
        """``spans`` of ``q`` bytes (fewer than ``LONG_SPAN``) from every place on that has as many, without index arrays."""
        n = max(len(self.buf) - q + 1, 0)
        h = np.full(n, mix(np.array([q], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))[0])
        for i in range(0, q if n else 0, 8):
            h ^= self.words[i : i + n] & _MASKS[min(q - i, 8)]
            h = mix(h)
        return h

    def equal_spans(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes from ``a`` on and from ``b`` on are equal over ``size`` bytes."""
        same = np.ones(len(size), bool)
        for i in np.flatnonzero(size >= LONG_SPAN).tolist():
            same[i] = np.array_equal(self.buf[a[i] : a[i] + size[i]], self.buf[b[i] : b[i] + size[i]])
        todo = np.flatnonzero((size < LONG_SPAN) & (size > 0))
        x, y, left = a[todo], b[todo], size[todo]
        while len(todo):
            differ = ((self.words[x] ^ self.words[y]) & _MASKS[np.minimum(left, 8)]) != 0
            same[todo[differ]] = False
            more = ~differ & (left > 8)
            todo, x, y, left = todo[more], x[more] + 8, y[more] + 8, left[more] - 8
        return same

    def exact_ids(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number per span, equal for spans of equal bytes and for no others: by hash, confirmed on the bytes."""
        h = self.spans(starts, ends)
        order = np.argsort(h, kind="stable")
        first, size = runs(h[order])
        ids = np.empty(len(h), np.int64)
        ids[order] = np.repeat(np.arange(len(first)), size)
        head = order[first][ids]
        other = np.flatnonzero(head != np.arange(len(h)))
        n = ends - starts
        alike = (n[other] == n[head[other]]) & self.equal_spans(starts[other], starts[head[other]], np.minimum(n[other], n[head[other]]))
        if not alike.all():  # two spans share a hash by chance: number them by their bytes
            seen: dict[bytes, int] = {}
            ids = np.array([seen.setdefault(self.buf[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        return ids


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a slice, and for each row the number of words before it (rows + 1 numbers)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True  # a row's first byte starts a word even if the row before ends in one
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a slice and its row offsets counted in them."""
    cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return cps, at[offs]


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1))
    return at, np.diff(np.concatenate((at, [len(sorted_values)])))


def unique_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(values)
    at, n = runs(s)
    return s[at], n
