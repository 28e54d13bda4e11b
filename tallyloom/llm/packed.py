"""Keyed counts that travel as packed numpy blocks: one row per bucket and batch instead of one per key."""

from __future__ import annotations

import numpy as np

from tallyloom.llm.blocks import U64


def add_up(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with sums of each count array."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    lead = np.flatnonzero(new)
    if len(lead) == 0:
        return (keys, *counts)
    return (keys[lead], *[np.add.reduceat(c[order], lead) for c in counts])


class Tally:
    """Counts per key, folded together whenever many parts have come in."""

    def __init__(self, columns: int, fold_at: int = 1 << 20):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.columns, self.fold_at, self.waiting = columns, fold_at, 0

    def add(self, keys: np.ndarray, *counts: np.ndarray) -> None:
        self.parts.append((keys, *counts))
        self.waiting += len(keys)
        if len(self.parts) > 1 and self.waiting > self.fold_at:
            folded = self.result()
            self.parts, self.waiting = [folded], 0
            self.fold_at = max(self.fold_at, len(folded[0]))

    def result(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, U64), *[np.zeros(0, np.int64)] * self.columns)
        return add_up(*[np.concatenate(c) for c in zip(*self.parts)])


def from_bytes(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)
