"""A suffix automaton over several sequences, with matching statistics."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """Accepts every substring of the sequences added so far; symbols are any hashable values."""

    def __init__(self):
        self.length, self.link, self.go = [0], [-1], [{}]

    def add(self, sequence: Sequence[Hashable]) -> None:
        length, link, go = self.length, self.link, self.go
        last = 0
        for symbol in sequence:
            known = go[last].get(symbol)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._clone(last, symbol, known)
                continue
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            go.append({})
            state = last
            while state != -1 and symbol not in go[state]:
                go[state][symbol] = new
                state = link[state]
            if state != -1:
                target = go[state][symbol]
                link[new] = target if length[target] == length[state] + 1 else self._clone(state, symbol, target)
            last = new

    def _clone(self, state: int, symbol: Hashable, target: int) -> int:
        """Splits off the short substrings of ``target`` that end in ``state`` and ``symbol``."""
        length, link, go = self.length, self.link, self.go
        copy = len(length)
        length.append(length[state] + 1)
        link.append(link[target])
        go.append(dict(go[target]))
        link[target] = copy
        while state != -1 and go[state].get(symbol) == target:
            go[state][symbol] = copy
            state = link[state]
        return copy

    def matches(self, sequence: Sequence[Hashable]) -> list[int]:
        """Matching statistics: per place, the longest known substring that ends there."""
        length, link, go = self.length, self.link, self.go
        out, state, size = [], 0, 0
        for symbol in sequence:
            following = go[state].get(symbol)
            while following is None and state:
                state = link[state]
                size = length[state]
                following = go[state].get(symbol)
            if following is None:
                size = 0
            else:
                state, size = following, size + 1
            out.append(size)
        return out
