"""crc32 of many words at once, in flat arrays."""

from __future__ import annotations

import zlib

import numpy as np

#: Longer words are few and go to the library one by one.
LONG = 64
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_STEP = _byte_table()


def _apply(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by its images of each of the four bytes."""
    out = tables[0][value & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ tables[i][(value >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def _zero_runs(doublings: int) -> list[np.ndarray]:
    """What appending 1, 2, 4 ... zero bytes does to a checksum, as tables for ``_apply``."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    images, out = _STEP[bits & np.uint32(255)] ^ (bits >> np.uint32(8)), []
    for _ in range(doublings):
        tables = np.zeros((4, 256), np.uint32)
        for i in range(32):
            has = (np.arange(256) >> (i % 8)) & 1 == 1
            tables[i // 8][has] ^= images[i]
        out.append(tables)
        images = _apply(tables, images)
    return out


_ZEROS = _zero_runs(32)


def crc32_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of ``data[start : start + length]`` for every word."""
    order = np.argsort(-lengths, kind="stable")
    first, left = starts[order], lengths[order]
    register = np.full(len(order), _ALL)
    going = np.searchsorted(-left, -np.arange(min(LONG, left[0] if len(left) else 0)), side="left")
    for i, n in enumerate(going.tolist()):
        here = register[:n]
        register[:n] = _STEP[(here ^ data[first[:n] + i]) & np.uint32(255)] ^ (here >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = register ^ _ALL
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


def crc32_joined(one: np.ndarray, two: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two strings in one, from those of either and the length of the second."""
    out, k = one.copy(), 0
    while (length >> k).any():
        has = (length >> k) & 1 == 1
        out[has] = _apply(_ZEROS[k], out[has])
        k += 1
    return out ^ two


def crc32_with_byte(one: np.ndarray, byte: int) -> np.ndarray:
    """crc32 of strings with one more byte at their end."""
    register = one ^ _ALL
    return (_STEP[(register ^ np.uint32(byte)) & np.uint32(255)] ^ (register >> np.uint32(8))) ^ _ALL
