"""Words of many texts as 64-bit numbers, by numpy over the UTF-8 bytes of an Arrow column.

A word is a run of anything but ASCII white space; A-Z count as a-z. Its number is a polynomial over its bytes modulo 2^64,
shifted to its place in the text and mixed, so that it depends on the word alone. Runs of numbers get numbers in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes whose words are found at once.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _byte_values() -> np.ndarray:
    lower = np.arange(256)
    lower[65:91] += 32
    return mix(mix((lower.astype(np.uint64) + np.uint64(1)) * _BASE))


_VALUE = _byte_values()
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def run_numbers(x: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of `width` of x."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def _block(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of a block, and the number of words before each edge (a place where a text begins or ends)."""
    word = ~_BLANK[data]
    if not word.any():
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, edges)


def _pieces(data: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """A long text in parts of about `block` bytes, cut before a blank."""
    at = 0
    while at < len(data):
        end = min(at + block, len(data))
        step = end
        while end < len(data) and not _BLANK[data[end]]:
            step = min(len(data), end + block)
            blanks = np.flatnonzero(_BLANK[data[end:step]])
            end = end + int(blanks[0]) if len(blanks) else step
        yield data[at:end]
        at = end


def word_numbers(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, numbers of all their words, number of words before each row and at the end) for slices of a text column; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        own = data[offsets[at] : offsets[end]]
        if len(own) <= 2 * block:
            yield (at, end, *_block(own, offsets[at : end + 1] - offsets[at]))
        else:
            parts = [_block(p, np.empty(0, np.int64))[0] for p in _pieces(own, block)]
            words = np.concatenate(parts)
            yield at, end, words, np.array([0, len(words)])
        at = end
