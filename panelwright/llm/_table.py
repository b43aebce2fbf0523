"""A bounded table of words, as a task meets them."""

from __future__ import annotations

from collections.abc import Callable

#: Longer words are worked out each time and not kept.
KEPT_CHARS = 64


class Odd(Exception):
    """The word can't be treated by itself: its text has to be cut with care."""


class Table(dict):
    """Word -> value, worked out by ``make`` when it is met first.

    There are two generations of ``rows`` words: a full one becomes the old one, and words that are met again move on.  So
    memory is bounded whatever the vocabulary of the corpus, and a word that has left the table is worked out again.
    """

    def __init__(self, make: Callable, rows: int):
        super().__init__()
        self.make, self.rows, self.old = make, rows, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > KEPT_CHARS:
                return value
        if len(self) >= self.rows:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
