"""Word and shingle hashes of whole Arrow batches of texts in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words are hashed in byte blocks of about this size, so that working arrays stay in cache.
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _table(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Separators: ASCII white space; or every ASCII character but letters and digits.
ASCII_SPACE = _table([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = _table([c for c in range(128) if not chr(c).isalnum()])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, BLOCK * 2), base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return data[first:last], offsets - first


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """(starts, ends, word offsets per text) of all words, in bytes."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~separators[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    at = offsets[:-1][filled]
    opens[at] = inside[at]
    at = offsets[1:][filled] - 1
    closes[at] = inside[at]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """64-bit hashes of the words, after folding bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = int(ends[j - 1])
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((fold[data[low:high]].astype(np.uint64) + np.uint64(1)) * _power(_BASE, high - low), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _power(_INVERSE, high - low)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``words[i : i + width]`` for every i, across texts; callers cut per text."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = h * _WINDOW + words[k : k + n]
    return mix(h + np.uint64(width))


def portions(texts: pa.Array, most: int = 2 << 20):
    """Yield (first, last + 1) of runs of texts with about ``most`` bytes, one text at least."""
    _, offsets = buffers(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def shingle_sets(texts: pa.Array, width: int = 5, separators: np.ndarray = ASCII_SPACE):
    """Yield, per text, the sorted distinct hashes of its shingles.

    Fewer words than ``width`` count as one shingle of all of them; no words give an empty set.
    """
    for low, high in portions(texts):
        yield from _shingle_sets(texts.slice(low, high - low), width, separators)


def _shingle_sets(texts: pa.Array, width: int, separators: np.ndarray):
    data, offsets = buffers(texts)
    starts, ends, at = word_spans(data, offsets, separators)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield words[:0]
