"""Which expressions of many can match a text: literals that a match must hold, found in one pass of an automaton.

For every expression a set of literals is derived from its parsed form, such that each match holds at least one of
them. An Aho-Corasick automaton over all literals tells in one pass over a text which sets are met; only those expressions are
tried. An expression without such a set is always tried, so a gate loses no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as _c  # type: ignore[attr-defined]
from re import _parser as _p  # type: ignore[attr-defined]

_MOST = 64
_LEAST = 2


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which every match of the expression holds one; None where none can be told."""
    parsed = _p.parse(pattern)
    return None if parsed.state.flags & re.IGNORECASE else _best(_of(parsed))


def _best(sets: Iterable[frozenset[str]]) -> frozenset[str] | None:
    """Of sets that all are required, the one whose shortest literal is longest, then the smallest."""
    return max((s for s in sets if s and len(s) <= _MOST), key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _of(tokens) -> list[frozenset[str]]:
    """Every set that a sequence requires."""
    out: list[frozenset[str]] = []
    run = ""
    for kind, arg in tokens:
        if kind is _c.LITERAL:
            run += chr(arg)
            continue
        if kind is _c.AT:  # takes no room
            continue
        if len(run) >= _LEAST:
            out.append(frozenset([run]))
        run = ""
        if kind is _c.SUBPATTERN and not arg[1] and not arg[2]:
            out += _of(arg[3])
        elif kind is _c.ATOMIC_GROUP:
            out += _of(arg)
        elif kind in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _of(arg[2])
        elif kind is _c.BRANCH:
            ways = [_best(_of(way)) for way in arg[1]]
            if all(ways):
                out.append(frozenset().union(*ways))
    if len(run) >= _LEAST:
        out.append(frozenset([run]))
    return out


class Gate:
    """Numbers of the expressions (of those given, from 0) that a text can match."""

    def __init__(self, patterns: Iterable[str | frozenset[str] | None]) -> None:
        """A string is an expression; a set is one of literals given by the caller."""
        import ahocorasick

        sets = [required(p) if isinstance(p, str) else p for p in patterns]
        self.always = frozenset(k for k, s in enumerate(sets) if not s)
        of: dict[str, set[int]] = {}
        for k, s in enumerate(sets):
            for literal in s or ():
                of.setdefault(literal, set()).add(k)
        self._automaton = ahocorasick.Automaton()
        for literal, numbers in of.items():
            self._automaton.add_word(literal, frozenset(numbers))
        self._automaton.make_automaton()
        self._any = bool(of)

    def of(self, text: str) -> set[int]:
        met = set(self.always)
        if self._any:
            for numbers in {found for _, found in self._automaton.iter(text)}:
                met |= numbers
        return met
