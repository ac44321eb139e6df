"""Hashes of words and of five-word shingles of whole texts, for all texts of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _B
    x = (x ^ (x >> np.uint64(33))) * _C
    return x ^ (x >> np.uint64(33))


def _byte_values() -> np.ndarray:
    """A value for each byte, the same for A-Z and a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _A)
    values[65:91] = values[97:123]
    return values


_BYTES = _byte_values()
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """The first n powers of _A and of its inverse, modulo 2 to the power of 64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((int(_A), pow(int(_A), -1, 1 << 64))):
            row = np.full(max(n, CHUNK + 1), x, dtype=np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row)
    return _powers


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first bytes, last bytes) of the words of texts that lie one after the other, and where each text's words begin."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.uint64), *[np.empty(0, dtype=np.int64)] * 2, np.zeros(len(offsets), dtype=np.int64)
    power, inverse = _tables(n + 1)
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    begins[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=sums[1:])
    hashes = mix((sums[last + 1] - sums[first]) * inverse[first] + (last - first + 1).astype(np.uint64) * _C)
    return hashes, first, last, np.searchsorted(first, offsets)


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, word hashes, bounds) for runs of texts of a column without nulls."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        part = offsets[at : stop + 1]
        hashes, _, _, bounds = words_in(data[part[0] : part[-1]], part - part[0])
        yield at, hashes, bounds
        at = stop


def word_hashes(text: str) -> np.ndarray:
    """Of the words [^\\x20\\x09-\\x0D]+ of one text, with A-Z lower-cased."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words_in(data, np.array([0, len(data)]))[0]


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """One for each place; a text of fewer words is one shingle, one without words has none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out = out * _A + words[i : n - k + 1 + i]
    return mix(out + np.uint64(k))


def shingles_of(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingle hashes) of each text of a column without nulls, in order."""
    for _, words, bounds in texts_of(column):
        whole = shingle_hashes(words, k) if len(words) >= k else words[:0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield words[a:b], whole[a : b - k + 1] if b - a >= k else shingle_hashes(words[a:b], k)
