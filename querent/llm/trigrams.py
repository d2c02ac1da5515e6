"""Boolean trigram queries derived from regular expressions.

The query of a pattern is a conjunction of clauses; a clause is a disjunction of alternatives; an alternative
is a set of trigrams that a matching text contains all of. No clause means that the pattern has no mandatory
trigram and every text has to be scanned. Case is folded: the queries hold for lower-cased texts.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: A set of possible strings larger than this is treated as unknown.
MOST_STRINGS = 16
Query = tuple[frozenset[frozenset[str]], ...]


def _grams(string: str) -> frozenset[str]:
    return frozenset(string[i : i + 3] for i in range(len(string) - 2))


def _clause(strings: frozenset[str]) -> frozenset[frozenset[str]] | None:
    """What a text has to contain if it contains one of ``strings``."""
    found = frozenset(_grams(s) for s in strings)
    return None if frozenset() in found or not found else found


def _walk(items) -> tuple[frozenset[str] | None, list[frozenset[frozenset[str]]]]:
    """The strings an item sequence can match (None: unknown) and the clauses of its parts."""
    run: frozenset[str] = frozenset({""})
    clauses: list[frozenset[frozenset[str]]] = []
    exact = True

    def flush() -> None:
        nonlocal run
        if (clause := _clause(run)) is not None:
            clauses.append(clause)
        run = frozenset({""})

    for kind, value in items:
        strings, inner = _item(kind, value)
        if strings is not None and len(joined := frozenset(a + b for a in run for b in strings)) <= MOST_STRINGS:
            run = joined
            continue
        flush()
        exact = False
        if strings is not None:
            run = strings
        clauses += inner
    if exact:
        return run, []
    flush()
    return None, clauses


def _item(kind, value) -> tuple[frozenset[str] | None, list[frozenset[frozenset[str]]]]:
    if kind is op.LITERAL:
        return frozenset({chr(value).lower()}), []
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            strings = frozenset().union(*(s for s, _ in parts))
            return (strings, []) if len(strings) <= MOST_STRINGS else (None, [c] if (c := _clause(strings)) else [])
        options: list[frozenset[frozenset[str]]] = []
        for strings, clauses in parts:  # one clause of each branch is enough for a sound disjunction
            best = _clause(strings) if strings is not None else max(clauses, key=lambda c: min(map(len, c)), default=None)
            if best is None:
                return None, []
            options.append(best)
        return None, [frozenset().union(*options)]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inside = value
        strings, clauses = _walk(inside)
        if strings is not None and most == 1:
            return strings | (frozenset({""}) if least == 0 else frozenset()), []
        if strings is not None and least == most and len(strings) == 1:
            return frozenset({next(iter(strings)) * most}), []
        return None, (clauses + ([c] if strings and (c := _clause(strings)) else [])) if least else []
    if kind is op.IN and len(value) <= MOST_STRINGS and all(k is op.LITERAL for k, _ in value):
        return frozenset(chr(c).lower() for _, c in value), []
    return None, []


def trigram_query(pattern: str) -> Query:
    """The clauses that every match of ``pattern`` implies for the lower-cased text around it."""
    strings, clauses = _walk(parser.parse(pattern))
    if strings is not None and (clause := _clause(strings)):
        clauses = [clause]
    return tuple(dict.fromkeys(clauses))
