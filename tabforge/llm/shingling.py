r"""Hashes of words and sets of shingles for whole Arrow batches of texts.

Words are runs of bytes outside ``[\x20\x09-\x0D]`` with A-Z lower-cased.  A word's
64-bit hash is the mixed sum of one random number per (place in the word, byte), so
all bytes of a batch are hashed by a few NumPy passes over Arrow's own buffer,
without a Python object per word or text.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)   # the SplitMix64 finaliser
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256)
_BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
# by place and byte; upper-case letters have the numbers of lower-case ones
_NUMBERS = mix((np.arange(PLACES)[:, None] * 256 + LOWER[None, :] + 1).astype(np.uint64) * GOLDEN).reshape(-1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their limits)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(ends), np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    body, limits = text_bytes(texts)
    inside = np.flatnonzero(~_BLANK[body])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.zeros(len(body) + 1, bool)
    begins[limits[:-1]] = True                       # a text's first byte starts a word
    start = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1] + 1]) | begins[inside])
    return run_hashes(body[inside], start), np.diff(np.searchsorted(inside[start], limits))


def run_hashes(body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at ``start`` in ``body``, the bytes of words alone."""
    length = np.diff(np.append(start, len(body)))
    place = np.arange(len(body)) - np.repeat(start, length)
    value = _NUMBERS[((place & (PLACES - 1)) << 8) | body]
    if length.max(initial=0) > PLACES:
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * GOLDEN)
    return mix(np.add.reduceat(value, start) + length.astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of the ``width``-word shingles of each text, one after the
    other; their limits).  Fewer words are one shingle, no words none."""
    words, counts = word_hashes(texts)
    first = np.concatenate([[0], counts.cumsum()])
    here = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))   # shingles with repeats
    limits = np.concatenate([[0], here.cumsum()])
    at = np.arange(limits[-1]) + np.repeat(first[:-1] - limits[:-1], here)
    size = np.repeat(np.minimum(counts, width), here)
    rolled = size.astype(np.uint64)
    for k in range(width):
        if k == 0 or counts.min(initial=width) >= width:
            rolled = mix(rolled * GOLDEN + words[at + k])
        else:                                        # short texts end before
            on = np.flatnonzero(size > k)
            rolled[on] = mix(rolled[on] * GOLDEN + words[at[on] + k])
    for s, e in zip(limits[:-1].tolist(), limits[1:].tolist()):
        rolled[s:e].sort()
    new = np.ones(len(rolled), bool)
    new[1:] = rolled[1:] != rolled[:-1]
    new[limits[:-1][here > 0]] = True
    return rolled[new], np.concatenate([[0], new.cumsum()])[limits]


def slices(flat: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
    return [flat[s:e] for s, e in zip(limits[:-1].tolist(), limits[1:].tolist())]
