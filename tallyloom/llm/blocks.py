"""Byte-level numpy helpers for text columns inside Arrow tasks.

Texts stay UTF-8 bytes: every separator the operators use is an ASCII byte, which never occurs
inside a multi-byte character. A *block* is a run of consecutive rows of one Arrow batch, cut so
that temporary arrays stay near ``BLOCK_BYTES`` times a small constant; a longer text is a block
of its own. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 19

SPACES = [0x20, *range(0x09, 0x0E)]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer: nearby inputs give unrelated outputs."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return splitmix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E6C63D0876A9A47 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_BYTE_VALUES = seeded(256, 11)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``; grown by doubling and kept per worker."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, U64)
        while len(known) < n:
            known = np.concatenate([known, known * U64(pow(base, len(known), 1 << 64))])
        _POWERS[base] = known
    return known


def fold_table(lower: bool = True) -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def separators(ranges) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(ranges)] = True
    return table


class Block:
    """Consecutive rows of a batch: ``data`` bytes, ``offsets`` of each row, first row ``row0``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row0: int):
        self.data, self.offsets, self.row0 = data, offsets, row0

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary Arrow column without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = text_buffers(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield Block(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


class Rolling:
    """Prefix sums of a polynomial hash over a sequence of 64-bit values, for O(1) range hashes."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * powers(BASE, len(values) + 1)[: len(values)], out=self.sums[1:])
        self.inverse = powers(BASE_INVERSE, len(values) + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]`` for arrays of starts and ends."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` values."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[:n]


def byte_hash(data: np.ndarray, fold: np.ndarray | None = None) -> Rolling:
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    return Rolling(values[data])


class Words:
    """Words of a block: ``start``/``end`` byte positions, ``hash``, ``first`` word index per row."""

    def __init__(self, block: Block, separator: np.ndarray, fold: np.ndarray | None = None, hashed: bool = True):
        data, offsets = block.data, block.offsets
        inside = ~separator[data]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[:-1] = inside
        # A row border cuts words: the byte before it ends one, the byte after starts another.
        starts = np.zeros(len(data) + 1, bool)
        starts[0] = True
        starts[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | starts[1:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | starts[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.block = block
        if hashed:
            self.hash = splitmix(byte_hash(data, fold).ranges(self.start, self.end))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.block.rows), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every ``n`` consecutive values (rows are not looked at)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for j in range(n):
        total = total * U64(BASE) + hashes[j : j + m]
    return splitmix(total)


def starts_within(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Marks the positions from which ``size`` items fit before the row's end."""
    ok = np.zeros(total, bool)
    if total == 0:
        return ok
    delta = np.zeros(total + 1, np.int64)
    lengths = np.diff(first)
    fits = lengths >= size
    np.add.at(delta, first[:-1][fits], 1)
    np.add.at(delta, (first[1:] - size + 1)[fits], -1)
    return np.cumsum(delta[:-1]) > 0


def window_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in every window of ``width``, the leftmost among equals.

    Only the upper 32 bits of ``order`` count. The position rides in the lower bits, so the
    minimum carries it; windows of doubled size are combined, ``log2(width)`` passes in all.
    """
    key = (order & U64(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=U64)
    n, size = len(order) - width + 1, 1
    if n <= 0:
        return np.zeros(0, np.int64)
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (key[:n] & U64(0xFFFFFFFF)).astype(np.int64)


class Anchors:
    """Runs of windows that choose the same anchor.

    Every window of ``span`` items picks the smallest ``k``-gram inside it, by content alone, so
    two equal windows pick equal k-grams at equal places. Consecutive windows of one row with the
    same pick form a run ``lo..hi``; the run's *fragment* is ``items[lo : hi + span]``.
    """

    def __init__(self, rolling: Rolling, first: np.ndarray, total: int, span: int, k: int):
        order = splitmix(rolling.windows(k))
        pick = window_argmin(order, span - k + 1)
        valid = np.flatnonzero(starts_within(first, span, total)[: len(pick)])
        at = pick[valid]
        if len(valid) == 0:
            empty = np.zeros(0, np.int64)
            self.lo = self.hi = self.row = self.at = empty
            self.anchor = self.fragment = np.zeros(0, U64)
            return
        row = np.searchsorted(first, valid, side="right") - 1
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        lead = np.flatnonzero(new)
        tail = np.append(lead[1:], len(valid)) - 1
        self.lo, self.hi, self.row = valid[lead], valid[tail], row[lead]
        self.at = picked = at[lead]
        self.anchor = order[picked]
        whole = rolling.ranges(self.lo, self.hi + span)
        shape = (picked - self.lo).astype(U64) * U64(1 << 32) + (self.hi - self.lo).astype(U64)
        self.fragment = splitmix(splitmix(whole) + splitmix(shape + U64(1)))
