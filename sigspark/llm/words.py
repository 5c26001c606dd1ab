"""Hashes of the words of Arrow text columns, computed over the bytes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed in one step; longer texts are cut between words.
STEP = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
#: Blank bytes: space and 09 to 0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_PLACE = 64
_POWERS = np.cumprod(np.full(_PLACE, 0xD6E8FEB86659FD93, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one text behind the other, and len + 1 offsets. A null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def _pieces(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about STEP bytes that end at the end of a document or at a blank."""
    begin, total = 0, len(data)
    while begin < total:
        end = min(begin + STEP, total)
        if end < total:
            last = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if last > begin:
                end = last
            else:  # within one document
                while end < total and not blank[data[end]]:
                    gap = np.flatnonzero(blank[data[end:end + STEP]])
                    end = end + int(gap[0]) if len(gap) else min(end + STEP, total)
                stop = int(offsets[np.searchsorted(offsets, begin, "right")])
                end = min(end, stop)
        yield begin, end
        begin = end


def word_hashes(column: pa.Array, blank: np.ndarray = BLANK, lower: np.ndarray = LOWER,
                spans: bool = False) -> tuple[np.ndarray, ...]:
    """Hash of every word, and where the words of each text begin in that list (len + 1 numbers).

    Words are runs of bytes that are not blank. spans adds the first byte of each word and the byte
    behind it, counted from the first byte of the column.
    """
    data, offsets = text_bytes(column)
    return hashes_of(data, offsets, blank, lower, spans)


def hashes_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK, lower: np.ndarray = LOWER,
              spans: bool = False) -> tuple[np.ndarray, ...]:
    """word_hashes of texts that are given as bytes and len + 1 offsets."""
    hashes, starts, ends = [], [], []
    for begin, end in _pieces(data, offsets, blank):
        part = data[begin:end]
        solid = ~blank[part]
        fresh = solid.copy()
        fresh[1:] &= ~solid[:-1]
        inner = offsets[np.searchsorted(offsets, begin, "left"):np.searchsorted(offsets, end, "left")] - begin
        inner = inner[inner < len(part)]
        fresh[inner] = solid[inner]
        first = np.flatnonzero(fresh)
        if not len(first):
            continue
        length = np.diff(np.append(first, len(part)))
        place = np.arange(first[0], len(part)) - np.repeat(first, length)
        values = (lower[part[first[0]:]].astype(np.uint64) + np.uint64(1)) * _POWERS[place & (_PLACE - 1)]
        if length.max() > _PLACE:
            values *= (place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        values[~solid[first[0]:]] = 0
        hashes.append(mix(np.add.reduceat(values, first - first[0])))
        starts.append(first + begin)
        if spans:
            last = solid.copy()
            last[:-1] &= ~solid[1:] | fresh[1:]
            ends.append(np.flatnonzero(last) + begin + 1)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    at = join(starts, np.int64)
    first_word = np.searchsorted(at, offsets, "left")
    out = (join(hashes, np.uint64), first_word)
    return (*out, at, join(ends, np.int64)) if spans else out


def shingles(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places are left out."""
    n = max(len(hashes) - k + 1, 0)
    out = np.full(n, (seed * int(_ODD)) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out + hashes[i:i + n]) * _ODD
            out ^= out >> np.uint64(29)
    return mix(out)


def within(first_word: np.ndarray, k: int, total: int) -> np.ndarray:
    """Marks the places from which k words lie in one text."""
    n = max(total - k + 1, 0)
    inside = np.ones(n, dtype=bool)
    for i in range(1, k):
        cut = first_word - i
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return inside
