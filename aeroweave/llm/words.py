"""Word splitting and hashing over whole Arrow string columns, without a Python object per word.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Hashes are 64-bit, the same in every
process, and independent of how rows are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time: bounds the temporary arrays, whatever the length of a text.
SLICE_BYTES = 1 << 20
_U = np.uint64

_seed = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _seed.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _U(0xD1342543DE82EF95)
_STEP_2 = _U(0xA24BAED4963EE407)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a 64-bit finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``n + 1`` row offsets; NULL counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a longer row is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of its first word (``n + 1`` values).

    ``between`` marks the byte values that part words.
    """
    solid = ~between[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = solid[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edges] = solid[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One hash per word."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(int(np.searchsorted(ends, low + SLICE_BYTES, "right")), at + 1)
        part = raw[low : ends[stop - 1]]
        if lower:
            part = _LOWER[part]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _powers(_BASE, len(part)), out=sums[1:])
        back = _powers(_BASE_INVERSE, len(part) + 1)
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def window_hashes(words: np.ndarray, width: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (``len(words) - width + 1`` values)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, width):
        total *= step
        total += words[k : k + n]
    return mix(total + _U(width))


def window_checks(words: np.ndarray, width: int) -> np.ndarray:
    """A second, independent 32-bit hash of the same runs."""
    return (window_hashes(mix(words ^ _STEP), width, _STEP_2) >> _U(32)).astype(np.uint32)


def inside(first_word: np.ndarray, width: int, n_windows: int) -> np.ndarray:
    """Marks the window starts that do not run over the end of their row."""
    ok = np.ones(n_windows, dtype=bool)
    for k in range(1, width):
        cut = first_word[1:-1] - k
        cut = cut[(cut >= 0) & (cut < n_windows)]
        ok[cut] = False
    return ok


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each distinct shingle, ordered by both.

    A row with fewer words than ``width`` has its whole word sequence as its only shingle, one
    without words has none.
    """
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends, lower)
    hashed = window_hashes(words, width)
    at = np.flatnonzero(inside(first, width, len(hashed)))
    row = np.searchsorted(first, at, "right") - 1
    hashed = hashed[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array(
            [window_hashes(words[first[r] : first[r + 1]], int(count[r]))[0] for r in short], np.uint64
        )
        row, hashed = np.concatenate([row, short]), np.concatenate([hashed, extra])
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[keep], hashed[keep]
