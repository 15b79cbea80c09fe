"""Vectorised word and shingle hashing for Arrow text columns.

Words are maximal runs of bytes that are not in a separator table; A-Z is folded to lower case first.
A word's hash is taken from its bytes and length (`span_hashes`); a shingle's hash combines the hashes of its words in
order. `hashed_words`, which features of the classifiers use, is quicker and weaker: a polynomial over the bytes modulo
2**64, for which unlike words can be made that share a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words: space and the ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * _CHUNK)
        for i, b in enumerate((_BASE, _BACK)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows (null rows are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Of a number's bytes, the first k.
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def eight_bytes(data: np.ndarray):
    """A function that gives the 8 bytes from each of some places on as numbers (zeros beyond the end)."""
    words = np.zeros(len(data) // 8 + 3, np.uint64)
    words.view(np.uint8)[: len(data)] = data

    def load(at: np.ndarray) -> np.ndarray:
        i, s = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (words[i] >> s) | ((words[i + 1] << np.uint64(1)) << (np.uint64(63) - s))

    return load


def span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[a:b], not linear in the bytes; spans of more than 16 bytes take a digest."""
    load, n = eight_bytes(data), b - a
    first, second = load(a) & MASKS[np.minimum(n, 8)], load(np.minimum(a + 8, len(data))) & MASKS[np.clip(n - 8, 0, 8)]
    with np.errstate(over="ignore"):
        h = mix(first ^ mix(second + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    far = np.flatnonzero(n > 16)
    if len(far):
        raw = data.tobytes()
        h[far] = np.frombuffer(b"".join(hashlib.blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(a[far].tolist(), b[far].tolist(), strict=True)), "<u8")
    return h


def word_spans(data: np.ndarray, starts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; a word does not run over any of the given row starts."""
    inside = ~sep[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    rows = starts[starts < len(data)]
    begin[rows] = inside[rows]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = rows[rows > 0]
    end[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hashed_words(data: np.ndarray, starts: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and 64-bit hash of every word of data."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b = word_spans(data, starts, sep)
    power, back = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD[data] + np.uint64(1)) * power[: len(data)], out=total[1:])
    return a, mix((total[b] - total[a]) * back[a])


def shingled(column: pa.Array, size: int, sep: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """The hashes of each row's shingles in order, with repeats; a row with fewer words than size
    gives its whole word sequence as one, a row without words gives none."""
    data, off = texts_of(column)
    row, n = 0, len(off) - 1
    with np.errstate(over="ignore"):
        while row < n:
            last = max(row + 1, int(np.searchsorted(off, off[row] + _CHUNK, "right")) - 1)
            part = LOWER[data[off[row] : off[last]]]
            a, b = word_spans(part, off[row:last] - off[row], sep)
            h = span_hashes(part, a, b)
            at = np.searchsorted(a, off[row : last + 1] - off[row])
            k = np.uint64(0xD6E8FEB86659FD93)
            whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
            for i in range(size):
                whole = whole * k + h[i : i + len(whole)]
            whole = mix(whole)
            for i in range(last - row):
                lo, hi = at[i], at[i + 1]
                if hi - lo >= size:
                    yield whole[lo : hi - size + 1]
                elif hi > lo:
                    acc = np.uint64(hi - lo)
                    for w in h[lo:hi]:
                        acc = acc * k + w
                    yield mix(np.array([acc], np.uint64))
                else:
                    yield whole[:0]
            row = last
