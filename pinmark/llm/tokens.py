"""Words and hashes of a batch of texts as numpy arrays.

All functions work on the bytes of an Arrow string column as a whole, without a Python loop over rows. A separator is a
set of ASCII bytes, which in UTF-8 never are part of another character. Hashes of short slices are polynomials modulo 2^64
over random byte values, so that any of them is hashed by two look-ups, and are mixed at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: ``[\x20\x09-\x0D]``
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII bytes that are neither letters nor digits, upper-case letters left out: they are folded first.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD1B54A32D192ED03
_VALUES = np.random.default_rng(20).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


_kept_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64; the longest array asked for so far is kept."""
    kept = _kept_powers.get(base)
    if kept is None:
        kept = np.ones(1, np.uint64)
    while len(kept) < n:
        kept = np.concatenate([kept, kept * np.uint64(pow(base, len(kept), 2**64))])
    if n <= 1 << 24:
        _kept_powers[base] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the place where each row begins with the end as last item. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; nothing else changes."""
    return _FOLD[data]


@dataclass
class Words:
    """Byte ranges of all words of a batch, in order, and ``first[i]:first[i + 1]``, the words of row i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    """Runs of bytes that are no separators; a run ends where its row ends."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    begins[borders] = inside[1:-1][borders]
    stops[borders - 1] = inside[1:-1][borders - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


#: Slices above this length are hashed one at a time. Polynomials modulo 2^64 give the same number for some different
#: texts of regular structure (Thue-Morse words), whatever their base, once these are long enough.
_LONG_SLICE = 32


def whole_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of each ``data[start:end]``, one slice after the other."""
    raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def slices_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_BASE, n), out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * powers(_inverse(_BASE), n + 1)[starts])
    long = np.flatnonzero(ends - starts > _LONG_SLICE)
    if len(long):
        out[long] = whole_hash(data, starts[long], ends[long])
    return out


def windows_hash(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The Rabin-Karp hash of every ``width`` successive items that lie in one row, and the first item of each."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_WINDOW_BASE, n), out=sums[1:])
    rolled = (sums[width:] - sums[:-width]) * powers(_inverse(_WINDOW_BASE), n - width + 1)
    last = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= last)
    return mix(rolled[at]), at


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in one of the windows that begin at ``at``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1) if len(at) < 1000 else change.__iadd__(np.bincount(at, minlength=n + 1))
    np.subtract.at(change, at + width, 1) if len(at) < 1000 else change.__isub__(np.bincount(at + width, minlength=n + 1))
    return np.cumsum(change[:-1]) > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the items of each row; 0 for a row without any."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all slices one after the other, and the length of each slice."""
    lengths = ends - starts
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.uint8), lengths
    places = np.ones(total, np.int64)
    filled = lengths > 0
    heads = np.concatenate([[0], np.cumsum(lengths[filled])[:-1]])
    places[heads[0]] = starts[filled][0]
    places[heads[1:]] = starts[filled][1:] - ends[filled][:-1] + 1
    return data[np.cumsum(places)], lengths


def joined(data: np.ndarray, words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per row its (kept) words with one space between them: bytes and row offsets."""
    starts, ends, rows = words.starts, words.ends, words.rows
    first = words.first
    if keep is not None:
        starts, ends, rows = starts[keep], ends[keep], rows[keep]
        first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(first) - 1))]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(first), np.int64)
    padded = np.append(data, np.uint8(0x20))
    # Each word with the byte after it, which is made a space; the space after the last word of a row is left out.
    out, lengths = cut(padded, starts, ends + 1)
    stops = np.cumsum(lengths)
    out[stops - 1] = 0x20
    last = np.zeros(len(starts), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    held = np.ones(len(out), bool)
    held[stops[last] - 1] = False
    sizes = row_sums(lengths - last, first)
    return out[held], np.concatenate([[0], np.cumsum(sizes)])


def to_strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
