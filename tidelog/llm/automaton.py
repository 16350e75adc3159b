"""A generalised suffix automaton over words, packed into arrays for the way to the workers."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence

_NONE = -1


class _Grown:
    """The automaton while it grows: lists by state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [_NONE], [0]

    def _new(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            there = self.next[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        state = self._new({}, 0, self.length[last] + 1)
        at = last
        while at != _NONE and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at != _NONE:
            there = self.next[at][word]
            self.link[state] = there if self.length[there] == self.length[at] + 1 else self._clone(at, word, there)
        return state

    def _clone(self, at: int, word: int, there: int) -> int:
        clone = self._new(dict(self.next[there]), self.link[there], self.length[at] + 1)
        self.link[there] = clone
        while at != _NONE and self.next[at].get(word) == there:
            self.next[at][word] = clone
            at = self.link[at]
        return clone


class SuffixAutomaton:
    """Every run of words of the given texts.

    ``base`` leads from a state to the one of its last ``least`` words; only those states list the texts
    that hold their words, so the lists together are no longer than the texts. Nearly all states have
    one transition; it lies in two arrays, and only further ones in a dictionary.
    """

    def __init__(self, texts: Iterable[Sequence[str]], least: int):
        self.least = least
        self.number: dict[str, int] = {}
        numbered = [[self.number.setdefault(word, len(self.number)) for word in text] for text in texts]
        grown = _Grown()
        for text in numbered:
            last = 0
            for word in text:
                last = grown.extend(last, word)
        self._pack(grown)
        held: dict[int, list[int]] = {}
        for i, text in enumerate(numbered):
            state = 0
            for place, word in enumerate(text):
                state = self._following(state, word)
                if place + 1 >= least:
                    texts_here = held.setdefault(self.base[state], [])
                    if not texts_here or texts_here[-1] != i:
                        texts_here.append(i)
        self.held = {state: tuple(numbers) for state, numbers in held.items()}

    def _pack(self, grown: _Grown) -> None:
        states = len(grown.next)
        self.link, self.length = array("i", grown.link), array("i", grown.length)
        self.word, self.to = array("i", [_NONE]) * states, array("i", [_NONE]) * states
        self.more: dict[int, int] = {}
        for state, following in enumerate(grown.next):
            for i, (word, to) in enumerate(following.items()):
                if i == 0:
                    self.word[state], self.to[state] = word, to
                else:
                    self.more[state << 32 | word] = to
        self.base = array("i", [_NONE]) * states
        for state in sorted(range(1, states), key=grown.length.__getitem__):
            if grown.length[state] >= self.least:
                above = grown.link[state]
                self.base[state] = self.base[above] if grown.length[above] >= self.least else state

    def _following(self, state: int, word: int) -> int:
        return self.to[state] if self.word[state] == word else self.more.get(state << 32 | word, _NONE)

    def matches(self, words: Iterable[str]) -> Iterable[tuple[int, int, tuple[int, ...]]]:
        """(place of the last word, matching length, numbers of the texts) wherever at least ``least`` words match."""
        number, first, to, more, link, length = self.number, self.word, self.to, self.more, self.link, self.length
        base, held, least = self.base, self.held, self.least
        state = matched = 0
        for place, text in enumerate(words):
            word = number.get(text)
            if word is None:
                state = matched = 0
                continue
            while True:
                following = to[state] if first[state] == word else more.get(state << 32 | word, _NONE)
                if following != _NONE or not state:
                    break
                state = link[state]
                matched = length[state]
            if following == _NONE:
                matched = 0
                continue
            state = following
            matched += 1
            if matched >= least:
                yield place, matched, held[base[state]]
