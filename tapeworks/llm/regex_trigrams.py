"""Boolean trigram queries from regular expressions: what any text must hold that the expression matches."""

from __future__ import annotations

import re
import re._constants as c
import re._parser as parser
from itertools import product

MOST = 32
#: A query is a conjunction of disjunctions of conjunctions of trigrams: frozenset[frozenset[frozenset[str]]]. Empty: no text is ruled out.
Query = frozenset
EVERY: Query = frozenset()
#: Letters that ignoring case also matches with characters outside ASCII (i, s and k have such forms), unless re.ASCII is set.
FOLDED = frozenset("iIsSkK")


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _of_strings(strings: set[str]) -> Query:
    """The text holds one of ``strings``."""
    sets = {trigrams(s) for s in strings}
    return EVERY if not sets or frozenset() in sets else frozenset([frozenset(x for x in sets if not any(y < x for y in sets))])


def _either(queries: list[Query]) -> Query:
    """One of ``queries`` holds: a conjunction for each choice, all trigrams of a choice taken together."""
    if EVERY in queries:
        return EVERY
    chosen = [frozenset().union(*parts) for q in queries for parts in product(*q)]
    return frozenset([frozenset(chosen)])


def _character(code: int, flags: int) -> str | None:
    """The character in lower case; None if a text may hold its match as bytes that ASCII's lower case doesn't cover."""
    loose = flags & re.IGNORECASE and not flags & re.ASCII
    return None if code > 127 or loose and chr(code) in FOLDED else chr(code).lower()


def _walk(items, flags: int) -> tuple[set[str] | None, Query]:
    """(all strings it can match, in lower case, or None if they are too many or not ASCII; what its matches hold)."""
    runs: set[str] = {""}
    whole, query = True, EVERY
    for op, arg in items:
        strings, inner = _item(op, arg, flags)
        if strings is not None and len(runs) * len(strings) <= MOST:
            runs = {a + b for a in runs for b in strings}
            continue
        query |= _of_strings(runs) | inner
        whole = False
        runs = strings if strings is not None else {""}
    return (runs, query | _of_strings(runs)) if whole else (None, query | _of_strings(runs))


def _item(op, arg, flags: int) -> tuple[set[str] | None, Query]:
    if op is c.LITERAL:
        one = _character(arg, flags)
        return (None if one is None else {one}), EVERY
    if op is c.IN:
        codes: list[int] = []
        for kind, x in arg:
            if kind is c.LITERAL:
                codes.append(x)
            elif kind is c.RANGE and x[1] - x[0] < 8:
                codes += range(x[0], x[1] + 1)
            else:
                return None, EVERY
        members = {_character(x, flags) for x in codes}
        return (members if None not in members and len(members) <= 8 else None), EVERY
    if op is c.SUBPATTERN:
        return _walk(arg[3], (flags | arg[1]) & ~arg[2])
    if op is c.BRANCH:
        found = [_walk(x, flags) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST:
            return set().union(*(s for s, _ in found)), _either([q for _, q in found])
        return None, _either([q for _, q in found])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _walk(inner, flags)
        if strings is not None and most <= 4 and len(strings) ** most <= MOST:
            return {"".join(x) for n in range(least, most + 1) for x in product(strings, repeat=n)}, EVERY
        return None, query if least else EVERY
    if op is c.AT or op in (c.ASSERT, c.ASSERT_NOT):
        return {""}, EVERY
    return None, EVERY


def query(pattern: str, flags: int = 0) -> Query:
    """The trigram query of ``pattern``, on text whose ASCII letters are in lower case. ``EVERY`` if all its matches share no trigram.

    Trigrams are of ASCII characters alone; what stands outside ASCII, or folds there when case is ignored, may be anything.
    """
    parsed = parser.parse(pattern, flags)
    return _walk(parsed, parsed.state.flags)[1]
