"""A generalised suffix automaton over words, with the items of every window of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class WindowAutomaton:
    """All word runs of some items; names the items in which a run's last words are a window.

    A window is ``width`` consecutive words of an item; an item of fewer words is one window
    of its own length.  ``owners`` holds, per state, the items with the window of ``width``
    words that the state spells, ``shorts`` the (length, item) of short items that it spells.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], width: int):
        self.width = width
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        kept = [(item, words) for item, words in items if words]
        for _, words in kept:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark(kept)

    def _extend(self, last: int, word: bytes) -> int:
        """The state of the longest run that ends with ``word`` after ``last``."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
        state = self._state({}, self.size[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            known = self.next[at][word]
            exact = self.size[known] == self.size[at] + 1
            self.link[state] = known if exact else self._split(at, word, known)
        return state

    def _state(self, transitions: dict[bytes, int], size: int) -> int:
        self.next.append(transitions)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1

    def _split(self, at: int, word: bytes, known: int) -> int:
        """A state for the shorter runs of ``known``, those that end after ``at``."""
        clone = self._state(dict(self.next[known]), self.size[at] + 1)
        self.link[clone], self.link[known] = self.link[known], clone
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _mark(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        width = self.width
        #: the state on a state's link path that spells its last ``width`` words, -1 if it is shorter
        self.window = [-1] * len(self.size)
        #: the nearest state on the link path, itself included, that spells a short item
        self.short_at = [-1] * len(self.size)
        self.owners: dict[int, tuple[str | None, ...]] = {}
        self.shorts: dict[int, list[tuple[int, str | None]]] = {}
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for state in order:
            if self.size[state] >= width:
                up = self.link[state]
                self.window[state] = state if self.size[up] < width else self.window[up]
        owners: dict[int, dict[str | None, None]] = {}
        for item, words in items:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at + 1 >= width:
                    owners.setdefault(self.window[state], {})[item] = None
            if len(words) < width:
                while self.size[self.link[state]] >= len(words):
                    state = self.link[state]
                self.shorts.setdefault(state, []).append((len(words), item))
        self.owners = {state: tuple(names) for state, names in owners.items()}
        for state in order:
            self.short_at[state] = state if state in self.shorts else self.short_at[self.link[state]]

    def matches(self, pieces: Iterable[list[bytes]]) -> Iterator[tuple[int, int, tuple[str | None, ...]]]:
        """(end, length, items) wherever windows end in a stream of words.

        ``length`` is the longest run of words up to ``end`` that an item has too (at least
        one window), or a short item's length where that run is shorter than a window.
        """
        follow, link, size, width = self.next, self.link, self.size, self.width
        window, short_at, owners, shorts = self.window, self.short_at, self.owners, self.shorts
        state = length = end = 0
        root = follow[0]
        for words in pieces:
            for end, word in enumerate(words, end + 1):
                onward = follow[state].get(word) if state else root.get(word)
                if onward is None:
                    while state and onward is None:
                        state = link[state]
                        onward = follow[state].get(word)
                    if onward is None:
                        state = length = 0
                        continue
                    length = size[state]
                state = onward
                length += 1
                if length >= width:
                    yield end, length, owners[window[state]]
                short = short_at[state]
                while short > 0:
                    for run, item in shorts[short]:
                        if run <= length:
                            yield end, run, (item,)
                    short = short_at[link[short]]
