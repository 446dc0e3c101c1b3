"""Whole texts of an Arrow batch as numpy arrays of bytes, words and word hashes.

A word is a run of bytes outside the white space 0x20 and 0x09-0x0D. Hashes are 64-bit and the same in
every process. Batches are cut into pieces of bounded size; one text is never cut.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
# A large block that is freed once makes the C library keep the blocks after it for reuse. Otherwise the arrays of every
# piece go back to the system and come again page by page, which takes almost half of the time.
np.empty(31 << 20, np.uint8)

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix((np.arange(1, 257, dtype=np.uint64)) * _GOLDEN)


class Piece(NamedTuple):
    """Consecutive texts of a batch: their bytes, and where each text starts (one more offset than texts)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of at most ``limit`` bytes, or one text where that is longer. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _valid, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield Piece(start, data[at[start] : at[stop]], at[start : stop + 1] - at[start])
        start = stop


class Words(NamedTuple):
    """Words of a piece in order: byte ranges, and for each text the index of its first word (one more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(piece: Piece, outside: np.ndarray = IS_SPACE) -> Words:
    """Find the words of every text; no word crosses from one text into the next. ``outside``: bytes between words."""
    inside = ~outside[piece.data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = piece.offsets[:-1][piece.offsets[:-1] < len(inside)]
    opens[begins] = inside[begins]
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE_BYTES + 1, n)
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of byte ranges: equal bytes (A-Z as a-z if ``lower``) give equal hashes wherever they stand."""
    up, down = _power_tables(len(data) + 1)
    codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the array is k - 1 shorter (empty if there are fewer words)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = word_hashes[:n].copy()
    for j in range(1, k):
        h *= np.uint64(_BASE)
        h += word_hashes[j : j + n]
    return mix(h)


class Grams(NamedTuple):
    """Word k-grams of a piece: hash, text and index of the first word; texts with fewer words give none."""

    hashes: np.ndarray
    text: np.ndarray
    word: np.ndarray


def grams(hashes: np.ndarray, w: Words, k: int) -> Grams:
    """All k-grams that stay inside one text."""
    text = w.text_of
    n = max(0, len(hashes) - k + 1)
    inside = text[:n] == text[k - 1 : k - 1 + n]
    at = np.flatnonzero(inside)
    return Grams(gram_hashes(hashes, k)[at], text[at], at)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of hashed values, the same for the same run at any place."""
    up, down = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """``run_hashes`` of the k values from every place on."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + np.full(1, k, np.uint64) * _GOLDEN)


def within(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Hashes that tell equal keys of different groups apart."""
    return mix(keys + group.astype(np.uint64) * _GOLDEN)


def sorted_sets(values: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each of ``n`` groups in ascending order, group after group, and where each group starts.

    ``group`` is the number of each value's group; sorting every group by itself is much faster than one sort of all.
    """
    if np.any(group[1:] < group[:-1]):
        order = np.argsort(group, kind="stable")
        values, group = values[order], group[order]
    else:
        values = values.copy()
    first = np.searchsorted(group, np.arange(n + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[new], np.searchsorted(group[new], np.arange(n + 1))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def starts_of_characters(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every code point."""
    return (data & 0xC0) != 0x80


class Lines(NamedTuple):
    """Lines of a piece split at line feeds: byte ranges and text numbers."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def lines(piece: Piece) -> Lines:
    breaks = np.flatnonzero(piece.data == 0x0A)
    text_of_break = np.searchsorted(piece.offsets, breaks, "right") - 1
    starts = np.concatenate([piece.offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, piece.offsets[1:]])
    text = np.concatenate([np.arange(piece.n), text_of_break])
    order_starts = np.lexsort((starts, text))
    order_ends = np.lexsort((ends, np.concatenate([text_of_break, np.arange(piece.n)])))
    return Lines(starts[order_starts], ends[order_ends], text[order_starts])
