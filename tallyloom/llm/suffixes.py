"""Suffix order, longest common prefixes and longest previous factors of byte arrays, in numpy."""

from __future__ import annotations

import numpy as np

from tallyloom.llm.blocks import U64


def _dense(key: np.ndarray) -> np.ndarray:
    """1-based ranks; equal keys share a rank."""
    order = np.argsort(key)
    ranked = key[order]
    step = np.ones(len(key), np.int64)
    step[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(key), U64)
    out[order] = np.cumsum(step).astype(U64)
    return out


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([ranks[by:], np.zeros(min(by, len(ranks)), U64)])


class SuffixOrder:
    """The suffixes of ``data`` that begin at ``starts``, sorted by their first ``span`` bytes.

    ``order`` indexes ``starts``; equal keys stand by position. ``lcp[i]`` is the common prefix of
    the suffixes at ``order[i - 1]`` and ``order[i]``, counted up to ``span``. Built by prefix
    multiplication: ranks of length-L prefixes, packed side by side, give those of length 2L or 3L.
    Every start must have ``span`` bytes before the array ends.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, span: int):
        n = len(data)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.empty(n + 8, U64)
        for shift in range(8):
            part = padded[shift : shift + (n + 8 - shift) // 8 * 8].view(">u8")
            words[shift : shift + 8 * len(part) : 8] = part
        ranks, length = _dense(words[:n]), min(8, span)
        if span < 8:
            ranks = _dense(words[:n] >> U64(64 - 8 * span))
        self.levels = [(length, ranks)]
        bits = max(1, int(n).bit_length())
        fan = max(2, 63 // bits)
        while length < span:
            parts = min(fan, -(-span // length))
            reach = min(span, length * parts)
            at = [length * i for i in range(parts - 1)] + [reach - length]
            key = np.zeros(n, U64)
            for offset in at:
                key = (key << U64(bits)) | _shifted(ranks, offset)
            if reach == span:
                ranks = key
            else:
                ranks = _dense(key)
                self.levels.append((reach, ranks))
            length = reach
        self.starts, self.span, self.data = starts, span, padded
        chosen = ranks[starts]
        self.order = np.argsort(chosen, kind="stable")
        self.key = chosen[self.order]
        self.lcp = self._common(starts[self.order])

    def _common(self, at: np.ndarray) -> np.ndarray:
        lcp = np.zeros(len(at), np.int64)
        if len(at) < 2:
            return lcp
        left, right = at[:-1], at[1:]
        found = np.zeros(len(left), np.int64)
        whole = self.key[1:] == self.key[:-1]
        for length, ranks in reversed(self.levels):
            for _ in range(-(-self.span // length) if length == self.levels[-1][0] else 2):
                i, j = np.minimum(left + found, len(ranks) - 1), np.minimum(right + found, len(ranks) - 1)
                found += length * ((ranks[i] == ranks[j]) & (found + length <= self.span))
        for _ in range(min(8, self.span)):
            found += (self.data[left + found] == self.data[right + found]) & (found < self.span)
        lcp[1:] = np.where(whole, self.span, np.minimum(found, self.span - 1))
        return lcp


def _nearest_smaller(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Common prefix with the previous smaller position in suffix order; below ``least`` counts as 0.

    Pointers jump over runs that are already known to hold larger positions only, so the number
    of passes is logarithmic. ``m[i]`` is the smallest ``lcp`` between ``i`` and its pointer.
    """
    n = len(position)
    pointer, m = np.arange(n) - 1, lcp.copy()
    active = np.flatnonzero(m >= least)
    active = active[position[pointer[active]] > position[active]]
    while len(active):
        target = pointer[active]
        lower = np.minimum(m[active], m[target])
        jump = pointer[target]
        m[active], pointer[active] = lower, jump
        active = active[(lower >= least) & (jump >= 0)]
        active = active[position[pointer[active]] > position[active]]
    m[(m < least) | (pointer < 0)] = 0
    return m


def previous_factors(suffixes: SuffixOrder, position: np.ndarray, least: int) -> np.ndarray:
    """Longest-previous-factor array: per start, the longest prefix that also begins at a smaller ``position``.

    The best earlier match of a suffix is its previous or its next neighbour in suffix order with
    a smaller position. Lengths are counted up to the order's span and 0 below ``least``.
    """
    order = suffixes.order
    at, lcp = position[order], suffixes.lcp
    before = _nearest_smaller(at, lcp, least)
    mirrored = np.concatenate([[0], lcp[1:][::-1]])
    after = _nearest_smaller(at[::-1], mirrored, least)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out
