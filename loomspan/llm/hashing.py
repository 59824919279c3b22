"""Vectorised word and word-window hashing over Arrow string columns.

A word is a maximal run of bytes that a *word table* marks as word bytes.  Both
word definitions used by the operators cut only at ASCII bytes, so working on
UTF-8 bytes gives exactly the words that the code-point patterns give:

``BLANK``   ``[^\\x20\\x09-\\x0D]+``            (everything but ASCII white space)
``ALNUM``   ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z

Words are hashed with a random-table polynomial over Z/2^64 computed from one
running sum, and windows of k words by doubling (1, 2, 4, ... words), so the
cost is a few array operations per byte and per word, with no Python loop.
Slices are bounded in bytes; one very long text is hashed in pieces.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
BLANK = ~_IS_BLANK
ALNUM = (_BYTES >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))

_CHUNK = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_R = 0x2545F4914F6CDD1D | 3


def released(task: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back to the system when its task ends.

    Python workers live on for later stages; what one stage needed would count against the next.
    """

    def run(batches):
        yield from task(batches)
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * _C1 + (b ^ (b >> np.uint64(29))) * _C2)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _C1)
_POW = _powers(_R, _CHUNK + 1)
_INV = _powers(pow(_R, -1, 1 << 64), _CHUNK + 1)


@dataclass
class Words:
    """The words of some consecutive rows of a string column."""

    first_row: int
    buf: np.ndarray  # bytes, lower-cased where asked for
    raw: np.ndarray  # bytes as they were
    starts: np.ndarray
    ends: np.ndarray
    doc_off: np.ndarray  # words of row i: doc_off[i] .. doc_off[i + 1]
    hashes: np.ndarray
    at: np.ndarray  # bytes of row i: at[i] .. at[i + 1]

    @property
    def n_rows(self) -> int:
        return len(self.doc_off) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), np.diff(self.doc_off))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, in pieces of bounded size."""
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    a = 0
    while a < n:
        base = int(starts[a])
        b = int(np.searchsorted(ends, base + _CHUNK, side="right"))
        if b <= a:  # one word longer than a piece
            out[a] = xxhash.xxh64_intdigest(buf[base : int(ends[a])].tobytes())
            a += 1
            continue
        s, e = starts[a:b] - base, ends[a:b] - base
        top = int(e[-1])
        run = np.empty(top + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(_TABLE[buf[base : base + top]] * _POW[:top], out=run[1:])
        out[a:b] = mix((run[e] - run[s]) * _INV[s] + (e - s).astype(np.uint64) * _C2)
        a = b
    return out


def _slices(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1)
        yield a, min(b, n)
        a = b


def words_of(column: pa.Array, table: np.ndarray, lower: bool, max_bytes: int = 1 << 20) -> Iterator[Words]:
    """The words of a string column, some rows at a time; null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    for lo, hi in _slices(offsets, max_bytes):
        at = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        inside = table[raw]
        cut = at[:-1][at[:-1] < len(raw)]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[cut] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[cut[cut > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        buf = _LOWER[raw] if lower else raw
        yield Words(lo, buf, raw, starts, ends, np.searchsorted(starts, at), hash_spans(buf, starts, ends), at)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by doubling; row ends are not minded."""
    if len(hashes) < k:
        return np.empty(0, dtype=np.uint64)
    g, width = hashes, 1
    while 2 * width <= k:
        g = join2(g[:-width], g[width:])
        width *= 2
    if width < k:
        g = join2(g[: len(g) - (k - width)], g[k - width :])
    return g


def starts_in_row(doc_off: np.ndarray, k: int) -> np.ndarray:
    """True at each word that begins a run of k words of its own row (length: as windows())."""
    n = int(doc_off[-1])
    out = np.ones(max(0, n - k + 1), dtype=bool)
    for back in range(1, k):
        at = doc_off[1:-1] - back
        out[at[(at >= 0) & (at < len(out))]] = False
    return out


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` windows, the place of its smallest hash (the first of equal ones; some low bits give way)."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    low = np.uint64((1 << (width - 1).bit_length()) - 1)
    grams = grams & ~low
    best = grams[:n].copy()
    for j in range(1, width):
        np.minimum(best, grams[j : j + n] | np.uint64(j), out=best)
    return np.arange(n) + (best & low).astype(np.int64)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True at the n words covered by a window of the given width at one of the starts."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0
