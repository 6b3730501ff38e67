"""Words of many texts at once, as arrays over their UTF-8 bytes.

A text is never turned into Python strings: word bounds come from a table of
byte classes, and 64-bit word hashes from prefix sums of a polynomial over the
bytes, so a word of any length costs one subtraction and one product.  A long
text is worked on in parts; a word that parts cut is put together from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on together.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

#: A-Z as a-z; other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes outside the given ranges."""
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
ALNUM[0x41:0x5B] = True

_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (CHUNK + 1 at most) of the base and of its inverse."""
    if n > len(_pow[0]):
        for i, base in enumerate((_P, _P_INV)):
            grown = np.full(max(n, CHUNK + 1), base)
            grown[0] = 1
            _pow[i] = np.multiply.accumulate(grown)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows; ``first[i]:first[i + 1]`` are those of row i."""

    row: int
    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # in `data`
    ends: np.ndarray
    data: np.ndarray  # lower-cased bytes


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``size`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column, is_word: np.ndarray = SPACED) -> Iterator[Words]:
    """The words of a string column with A-Z lower-cased, chunk by chunk."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        raw = data[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        starts, ends, hashes, low = _scan(raw, bounds, is_word)
        yield Words(i, mix(hashes), np.searchsorted(starts, bounds).astype(np.int64), starts, ends, low)


def _scan(raw: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, polynomials, lower-cased bytes) of the words of rows that end at ``bounds``."""
    low, begun, done, found = np.empty(len(raw), np.uint8), [], [], []
    inside_before, cut = False, None  # cut: polynomial and length of a word that goes on in the next part
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        n = len(part)
        inside = is_word[part]
        edge = np.zeros(n, bool)
        edge[bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, at + n)] - at] = True  # a row's end ends its last word
        before = np.empty(n, bool)
        before[0], before[1:] = inside_before, inside[:-1]
        starts = np.flatnonzero(inside & (edge | ~before))
        ends = np.flatnonzero(before & (edge | ~inside))
        _LOWER.take(part, out=low[at : at + n])
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low[at : at + n]] * up[:-1], out=sums[1:])
        if cut is not None:  # the first end is its own, unless it goes on
            last = int(ends[0]) if len(ends) else n
            cut = cut[0] + np.uint64(pow(int(_P), cut[1], 1 << 64)) * sums[last : last + 1], cut[1] + last
            if len(ends):
                found.append(cut[0])
                done.append(ends[:1] + at)
                ends, cut = ends[1:], None
        open_ = starts[len(ends) :]  # at most one
        begun.append(starts + at)
        done.append(ends + at)
        starts = starts[: len(ends)]
        found.append((sums[ends] - sums[starts]) * down[starts])
        if len(open_):
            cut = (sums[n:] - sums[open_]) * down[open_], n - int(open_[0])
        inside_before = bool(inside[-1])
    if cut is not None:
        found.append(cut[0])
        done.append(np.array([len(raw)]))
    whole = lambda arrays, kind: np.concatenate(arrays) if arrays else np.empty(0, kind)
    return whole(begun, np.int64), whole(done, np.int64), whole(found, np.uint64), low


_ROLL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that start at each word (the last k - 1 have none)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out += hashes[i : i + n] * _ROLL[i]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one text; a shorter text is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    found = grams(hashes, min(k, len(hashes)))
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) > 1 else found
