"""A bounded store of learned values, and which characters all character tables agree on."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from meshlark.functions.worker import ship

ship(__name__)


class Held(dict):
    """Values by key, learned when first asked for. At ``most`` keys those not asked for since the last time go."""

    def __init__(self, learn: Callable, most: int):
        super().__init__()
        self.learn, self.most, self.before = learn, most, {}

    def __missing__(self, key):
        value = self.before.pop(key, None)
        if value is None:
            value = self.learn(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def settled(letter: str) -> bool:
    """Whether all versions of the character tables since Unicode 3.2 say the same of a character.

    Only of younger ones can this Python, its regex package and a tokenizer library, each with tables of its own
    version, think otherwise.
    """
    old = unicodedata.ucd_3_2_0.category(letter)
    return old != "Cn" and old == unicodedata.category(letter)


class Settled(Held):
    """Tells, by characters held, whether all those of a text are settled."""

    def __init__(self):
        super().__init__(settled, 1 << 17)

    def all_of(self, text: str) -> bool:
        return text.isascii() or all(map(self.__getitem__, set(text)))
