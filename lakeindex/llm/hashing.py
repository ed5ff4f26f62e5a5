"""Word and shingle hashes of whole Arrow batches with numpy: no Python object is made for a word."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from lakeindex.llm.common import byte_runs

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
NEAR = 64  # places of a word whose values are kept as a table
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _values() -> np.ndarray:
    """A random value for each byte at each of the first NEAR places of a word; A-Z have those of a-z, which folds case at no cost."""
    return _value(np.arange(NEAR * 256) >> 8, _folded(np.tile(np.arange(256), NEAR)))


def _folded(letters: np.ndarray) -> np.ndarray:
    return letters + 32 * ((letters >= 65) & (letters <= 90))


def _value(place: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return mix(mix(place.astype(np.uint64) * np.uint64(256) + letters.astype(np.uint64) + np.uint64(1)) ^ np.uint64(0xD6E8FEB86659FD93))


def _piece(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in these bytes; no word runs over an offset in starts_at.

    A word's hash mixes the sum of independent values of its letters at their places, and its length: no structure of letters
    carries over to sums, as it does to polynomials modulo a power of two.
    """
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = starts_at[(starts_at > 0) & (starts_at < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return np.zeros(0, np.uint64), s
    lengths, letters = e - s, data[word]
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    values = _values()[np.minimum(place, NEAR - 1) * 256 + letters]
    far = np.flatnonzero(place >= NEAR)
    if len(far):
        values[far] = _value(place[far], _folded(letters[far].astype(np.int64)))
    return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64) * _STEP), s


def _long(data: np.ndarray, most: int) -> np.ndarray:
    """Word hashes of one long text, in pieces cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        out.append(_piece(data[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out)


def word_hashes(column: pa.Array, most: int = 1 << 20):
    """Yields for each text the array of its lower-cased words' hashes."""
    for _, data, offsets in byte_runs(column, most):
        if len(offsets) == 2 and len(data) > most:
            yield _long(data, most)
            continue
        hashes, at = _piece(data, offsets)
        cuts = np.searchsorted(at, offsets)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield hashes[a:b]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of all windows of n words; of a shorter text that has words, one of the whole."""
    if not len(words):
        return words
    width = min(n, len(words))
    many = len(words) - width + 1
    out = np.full(many, np.uint64(width))
    for i in range(width):
        out = mix(out * np.uint64(0xA24BAED4963EE407 | 1) + words[i : i + many])
    return np.unique(out)


def shingle_sets(column: pa.Array, n: int):
    """Yields for each text the set of its word n-grams."""
    for words in word_hashes(column):
        yield shingles(words, n)
