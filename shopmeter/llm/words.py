"""Hashes of words and word shingles of whole texts, in flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_DRAW = np.random.default_rng(20240229)
#: A random 64-bit value per byte and an odd multiplier: words are polynomials over them.
_BYTE = _DRAW.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none) and where each text ends."""
    texts = texts.fill_null("").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word in order; A-Z count as a-z if ``lower``."""
    raw, ends = flat_bytes(texts)
    # A blank after every text keeps words of neighbouring texts apart.
    n, count = len(raw), len(ends)
    spaced = np.full(n + count, 0x20, np.uint8)
    owner = np.repeat(np.arange(count), np.diff(np.concatenate([[0], ends])))
    spaced[np.arange(n) + owner] = _LOWER[raw] if lower else raw
    inside = ~_BLANK[spaced]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    stops = np.flatnonzero(edge == -1)
    terms = _BYTE[spaced] * powers(len(spaced), _BASE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    hashes = (sums[stops] - sums[starts]) * powers(len(spaced) + 1, _INVERSE)[starts]
    hashes = mix(hashes ^ ((stops - starts).astype(np.uint64) << np.uint64(40)))
    text_ends = ends + np.arange(count)  # in ``spaced``, where the added blank lies
    return np.searchsorted(text_ends, starts, side="left"), hashes


_PLACE = _DRAW.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` words.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    owner, hashes = words(texts, lower)
    count = np.bincount(owner, minlength=len(texts))
    last = np.repeat(np.cumsum(count), count)  # of each word, where its text's words end
    start = np.arange(len(owner))
    runs = max(0, len(owner) - size + 1)
    total = np.zeros(runs, np.uint64)
    for i in range(size):
        total += hashes[i : i + runs] * _PLACE[i]
    whole = start[:runs] + size <= last[:runs]
    of, out = owner[:runs][whole], mix(total[whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count)[short] - count[short]
        fewer = count[short].astype(np.uint64)
        for i in range(size - 1):
            here = count[short] > i
            fewer[here] += hashes[first[here] + i] * _PLACE[i]
        of, out = np.concatenate([of, short]), np.concatenate([out, mix(fewer)])
    return of, out


def sets(texts: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the distinct shingles of every text, sorted, in one flat array."""
    of, hashes = shingles(texts, size, lower)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[fresh], np.cumsum(np.bincount(of[fresh], minlength=len(texts)))
