"""What the parsers share: token lists, a reader over them, and the way a text is judged.

A lexer turns a text into kinds: a letter for names, numbers and strings, and the text itself for keywords and signs.
Grammars read kinds from left to right and go back only where a language needs it; what a failed attempt has shown is
remembered, so a text of n tokens takes time in proportion to n. A sign that no token can start with, such as the quote
of a string that never ends or a conflict marker, is of kind ``X``, which no rule takes.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from itertools import islice

# Nested source is nested calls; calls between Python functions take heap, not stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))

REMEMBERED = 50_000
SHORT = 32  # tokens of the longest statement that is remembered
HEADS = (12, 24, 48, 96, 192, 384)  # tokens that are tried before a whole text is
END = ("", "", "", "", "", "")
MARKER = r"^(?:<{7}|={7}|>{7}|\|{7})(?![<>=|])"  # conflict markers at the start of a line
STRING = r'"(?:[^"\\\n]|\\.)*+"'
LINE = r"//[^\n]*"
BLOCK = r"/\*(?:[^*]|\*(?!/))*+\*/"
WORD = r"[^\W\d]\w*"
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Bad(Exception):
    """The tokens are not valid syntax."""


class Kinds(dict):
    """Kind of a token, worked out once per distinct token."""

    def __init__(self, of: Callable[[str], str]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> str:
        kind = self.of(token)
        if len(self) < REMEMBERED:
            self[token] = kind
        return kind


class Reader:
    """Reads kinds; ``p`` is the place, and reading past the end of a list without end marks is an IndexError."""

    def __init__(self, kinds: list[str]) -> None:
        self.k = kinds
        self.p = 0
        self._mates: dict[int, int] | None = None

    def recalled(self, end: str, known: set) -> tuple[int, tuple] | None:
        """Reads on past the next ``end`` if what stands before it has been read before; else its place and the kinds.

        A statement that ended there once ends there again, because no rule looks past the end of a statement; but for
        the one with an ``if``, which an ``else`` may follow.
        """
        try:
            at = self.k.index(end, self.p, self.p + SHORT)
        except ValueError:
            return -1, ()
        key = tuple(self.k[self.p : at])
        if "if" in key:
            return -1, ()
        if key in known:
            self.p = at + 1
            return None
        return at, key

    def headed(self, rule: Callable[[], object], known: set) -> None:
        """A rule that ends before a brace, remembered like a statement."""
        try:
            at = self.k.index("{", self.p, self.p + SHORT)
        except ValueError:
            rule()
            return
        key = tuple(self.k[self.p : at])
        if key in known:
            self.p = at
            return
        rule()
        if self.p == at and len(known) < REMEMBERED:
            known.add(key)

    def need(self, kind: str) -> None:
        if self.k[self.p] != kind:
            raise Bad
        self.p += 1

    def take(self, kind: str) -> bool:
        if self.k[self.p] == kind:
            self.p += 1
            return True
        return False

    def attempt(self, rule: Callable[[], object]) -> bool:
        """Read a rule, or nothing if it doesn't hold."""
        at = self.p
        try:
            rule()
        except Bad:
            self.p = at
            return False
        return True

    def mate(self, at: int) -> int:
        """Place of the bracket that closes the one at ``at``."""
        if self._mates is None:
            mates, open_ = {}, []
            for i, kind in enumerate(self.k):
                if kind in _PAIRS:
                    open_.append((i, _PAIRS[kind]))
                elif kind in (")", "]", "}"):
                    if not open_ or open_[-1][1] != kind:
                        break
                    mates[open_.pop()[0]] = i
            self._mates = mates
        if at not in self._mates:
            if self.k[-1:] == [""]:
                raise Bad
            raise IndexError
        return self._mates[at]

    def tree(self) -> None:
        """Anything between brackets that match."""
        if self.k[self.p] not in _PAIRS:
            raise Bad
        self.p = self.mate(self.p) + 1


class Grammar:
    """A language: ``tokens`` finds tokens, ``kind`` names them, ``reader`` has a rule ``file`` for whole texts."""

    def __init__(self, tokens: str, kind: Callable[[str], str], reader: type[Reader], space: str = r"\s*+") -> None:
        self.tokens = re.compile(f"{space}({tokens})", re.M | re.S)  # the space before a token is read with it
        self.kinds = Kinds(kind)
        self.reader = reader
        self.wrong: set[tuple] = set()  # beginnings that have been seen to be no beginning

    def lexed(self, tokens: list[str]) -> list[str]:
        return list(filter(None, map(self.kinds.__getitem__, tokens)))

    def bare(self, text: str) -> str:
        """The text that is read."""
        return text

    def part(self, kinds: list[str]) -> list[str]:
        """What of the kinds of a text's beginning can be judged without the rest."""
        return kinds

    def whole(self, text: str) -> list[str]:
        return self.lexed(self.tokens.findall(self.bare(text)))

    def holds(self, kinds: list[str]) -> bool:
        try:
            self.reader(kinds).file()
        except (Bad, IndexError):  # wrong, or in want of more at its end
            return False
        return True

    def valid(self, text: str) -> bool:
        kinds = self.whole(text)
        if "X" in kinds:
            return False
        kinds.extend(END)
        return self.holds(kinds)

    def foreign(self, text: str) -> bool:
        """``valid``, for a text of perhaps another language: its first tokens are tried before all are made."""
        found, tokens = self.tokens.finditer(self.bare(text)), []
        for most in HEADS:
            tokens += [m[1] for m in islice(found, most - len(tokens))]
            kinds = self.part(self.lexed(tokens))
            key = tuple(kinds)
            if key in self.wrong:
                return False
            try:
                self.reader(kinds).file()
            except Bad:
                if len(self.wrong) < REMEMBERED:
                    self.wrong.add(key)
                return False
            except IndexError:
                pass  # the head is valid as far as it goes
        return self.valid(text)
