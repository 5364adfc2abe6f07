"""Words of many texts as 64-bit hashes, computed on whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes between words: blank and the control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]
PART_BYTES = 2 << 20
PIECE_BYTES = 1 << 18  # what is hashed at once, for several numbers of 64 bits are needed for each byte


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 2 * len(_POWERS[0])), _BASE, np.uint64)
        steps[0] = 1
        _POWERS[0] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0]


def _hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in some texts that lie behind each other, and the number of words of each text."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = starts[starts < len(data)]
    first[borders] = inside[borders]
    at = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(at, np.append(starts, len(data))))
    if not len(at):
        return np.empty(0, np.uint64), counts
    signs = _LOWER[data[inside]]
    begin = np.cumsum(inside)[at] - 1
    sizes = np.diff(np.append(begin, len(signs)))
    place = np.arange(len(signs)) - np.repeat(begin, sizes)
    hashes = np.add.reduceat((signs.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[place], begin)
    return mix(hashes ^ (sizes.astype(np.uint64) * _BASE)), counts


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of runs of texts: place of the first, the hashes of all words, the number of words of each.

    A-Z count as lower case; null counts as empty. A run has about PART_BYTES, or is one longer text.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART_BYTES, "right")) - 1)
        end = min(end, len(texts))
        pieces, a = [], row
        while a < end:
            b = min(max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, "right")) - 1), end)
            pieces.append(_hash_words(whole[offsets[a]:offsets[b]], offsets[a:b] - offsets[a]))
            a = b
        yield row, np.concatenate([x[0] for x in pieces]), np.concatenate([x[1] for x in pieces])
        row = end
