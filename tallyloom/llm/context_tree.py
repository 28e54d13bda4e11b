"""Context-tree weighting over bytes: node counts, mixture weights and symbol probabilities in numpy.

A *gram* packs ``DEPTH`` context bytes and the byte that follows, the nearest context byte last but
one. A byte is eight binary decisions; a decision's node is the context's last ``d`` bytes plus the
bits already known (``1 .. 255``). Node ``s`` estimates by Krichevsky-Trofimov and mixes with its
children, the contexts one byte longer, half and half: ``Pw = (Pe + prod Pw(children)) / 2``.
"""

from __future__ import annotations

import math

import numpy as np

from tallyloom.llm.blocks import U64

DEPTH = 5
#: Depth of the contexts that deal grams into buckets; shallower nodes are shared by all buckets.
SHARED = 2

_SMALL = 4096
_HALF = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])
_WHOLE = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def _log_gamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """``lgamma(n + shift)`` of counts: a table, then Stirling's series."""
    x = np.maximum(n, _SMALL) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], series)


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _log_gamma(n0, _HALF, 0.5) + _log_gamma(n1, _HALF, 0.5) - math.log(math.pi) - _log_gamma(n0 + n1, _WHOLE, 1.0)


def grams_of(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One gram per byte of rows ``first[i] .. first[i + 1]``; contexts before a row's start are zero bytes."""
    wide = data.astype(U64)
    gram = wide.copy()
    since = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    for back in range(1, DEPTH + 1):
        earlier = np.zeros(len(data), U64)
        earlier[back:] = wide[:-back]
        earlier[since < back] = 0
        gram |= earlier << U64(8 * back)
    return gram


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Grams with the same ``SHARED`` nearest context bytes share a bucket."""
    near = (gram >> U64(8)) & U64((1 << (8 * SHARED)) - 1)
    return ((near * U64(0x9E3779B97F4A7C15) >> U64(32)) % U64(buckets)).astype(np.int64)


class Level:
    """Nodes of one depth for a set of grams: keys, counts, and per gram and bit the node's index."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int):
        symbol = (gram & U64(255)).astype(np.int64)
        context = (gram >> U64(8)) & U64((1 << (8 * depth)) - 1)
        step = np.arange(8)[:, None]
        node = (1 << step) | (symbol[None, :] >> (8 - step))
        bit = (symbol[None, :] >> (7 - step)) & 1
        key = ((context << U64(8))[None, :] | node.astype(U64)).reshape(-1)
        self.keys, at = np.unique(key, return_inverse=True)
        self.at = at.reshape(8, len(gram))
        weight = np.broadcast_to(count, (8, len(gram))).astype(np.float64)
        n = np.bincount(self.at.reshape(-1) * 2 + bit.reshape(-1), weights=weight.reshape(-1), minlength=2 * len(self.keys))
        self.n0, self.n1 = n[0::2].astype(np.int64), n[1::2].astype(np.int64)
        self.bit = bit

    def estimate(self) -> np.ndarray:
        """Per bit and gram, the node's own probability of the bit that follows."""
        n0, n1 = self.n0[self.at], self.n1[self.at]
        return (np.where(self.bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)


def parent_keys(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the nodes one byte shallower than depth-``depth`` nodes."""
    return keys & U64((1 << (8 * depth)) - 1)


class Subtrees:
    """All nodes of depth ``SHARED`` and below for the grams of a bucket."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.levels = {d: Level(gram, count, d) for d in range(SHARED, DEPTH + 1)}
        self.own: dict[int, np.ndarray] = {}
        below = None
        for depth in range(DEPTH, SHARED - 1, -1):
            level = self.levels[depth]
            block = log_block(level.n0, level.n1)
            if below is None:
                total = block
            else:
                # Weight of the node's own estimate against its children's product.
                self.own[depth] = 1 / (1 + np.exp(np.clip(below - block, -700, 700)))
                total = np.logaddexp(block, below) - math.log(2)
            parents = parent_keys(level.keys, depth)
            if depth > SHARED:
                at = np.searchsorted(self.levels[depth - 1].keys, parents)
                below = np.bincount(at, weights=total, minlength=len(self.levels[depth - 1].keys))
            else:
                self.roots, at = np.unique(parents, return_inverse=True)
                self.root_total = np.bincount(at, weights=total, minlength=len(self.roots))
                self.root_n0 = np.bincount(at, weights=level.n0, minlength=len(self.roots)).astype(np.int64)
                self.root_n1 = np.bincount(at, weights=level.n1, minlength=len(self.roots)).astype(np.int64)

    def probability(self) -> np.ndarray:
        """Per bit and gram, the mixture over depths ``SHARED .. DEPTH``."""
        p = self.levels[DEPTH].estimate()
        for depth in range(DEPTH - 1, SHARED - 1, -1):
            own = self.own[depth][self.levels[depth].at]
            p = own * self.levels[depth].estimate() + (1 - own) * p
        return p


class Crown:
    """Nodes above depth ``SHARED``; at most 255 per context of one byte, whatever the corpus."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        """Depth ``SHARED - 1`` nodes with the sums of their children's log probabilities."""
        order = np.argsort(keys)
        self.levels = []
        keys, n0, n1, below = keys[order], n0[order], n1[order], below[order]
        for depth in range(SHARED - 1, -1, -1):
            block = log_block(n0, n1)
            own = 1 / (1 + np.exp(np.clip(below - block, -700, 700)))
            self.levels.append((depth, keys, n0, n1, own))
            total = np.logaddexp(block, below) - math.log(2)
            if depth:
                parents = parent_keys(keys, depth)
                keys, at = np.unique(parents, return_inverse=True)
                n0, n1, below = (np.bincount(at, weights=v, minlength=len(keys)) for v in (n0, n1, total))
                n0, n1 = n0.astype(np.int64), n1.astype(np.int64)

    def log10(self, gram: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte; ``p`` is the mixture from ``SHARED`` down."""
        symbol = (gram & U64(255)).astype(np.int64)
        step = np.arange(8)[:, None]
        node = ((1 << step) | (symbol[None, :] >> (8 - step))).astype(U64)
        bit = (symbol[None, :] >> (7 - step)) & 1
        for depth, keys, n0, n1, own in self.levels:
            context = (gram >> U64(8)) & U64((1 << (8 * depth)) - 1)
            at = np.searchsorted(keys, (context << U64(8))[None, :] | node)
            estimate = (np.where(bit == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1.0)
            p = own[at] * estimate + (1 - own[at]) * p
        return np.log10(p).sum(axis=0)
