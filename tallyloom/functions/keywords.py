"""All keywords of several lists in one pass over a text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def _automaton(lists: tuple[tuple[str, ...], ...]):
    """Built once per worker; a hit names its word, the word's length and the lists that hold it."""
    import ahocorasick

    holders: dict[str, list[int]] = {}
    for at, words in enumerate(lists):
        for word in words:
            holders.setdefault(word, []).append(at)
    automaton = ahocorasick.Automaton()
    for number, (word, held) in enumerate(holders.items()):
        automaton.add_word(word, (number, len(word), held))
    if holders:
        automaton.make_automaton()
    return automaton if holders else None


def count_keywords(text: str, lists: tuple[tuple[str, ...], ...]) -> list[int]:
    """Occurrences per list; those of one word do not overlap, those of different words may."""
    counts = [0] * len(lists)
    automaton = _automaton(lists)
    if automaton is None:
        return counts
    free: dict[int, int] = {}
    for end, (number, size, held) in automaton.iter(text):
        if end - size >= free.get(number, -1):
            free[number] = end
            for at in held:
                counts[at] += 1
    return counts


def keyword_counts(text: Column | str, *lists: tuple[str, ...]) -> Column:
    """``array<int>``: how often the words of each list occur in a text, null for null.

    One Aho-Corasick automaton of all lists reads the text once, however many words they have.
    """
    known = tuple(tuple(dict.fromkeys(words)) for words in lists)

    @F.arrow_udf("array<int>")
    def scan(texts: pa.Array) -> pa.Array:
        none = [0] * len(known)
        rows = [count_keywords(t, known) if t is not None else none for t in texts.to_pylist()]
        flat = pa.array(np.array(rows, np.int32).ravel())
        at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(known))
        return pa.ListArray.from_arrays(at, flat, mask=texts.is_null()) if texts.null_count else pa.ListArray.from_arrays(at, flat)

    return scan(F.col(text) if isinstance(text, str) else text)
