"""Boolean trigram queries: what every match of a regular expression must contain.

A query is a set of alternatives, each a set of lower-cased trigrams that must all occur; the empty alternative means that nothing is known.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from itertools import product

Query = frozenset[frozenset[str]]
NOTHING: Query = frozenset([frozenset()])
#: Strings that a part may match exactly are followed up to this number; beyond it the part counts as unknown text.
MOST_STRINGS = 64


def _both(a: Query, b: Query) -> Query:
    return _shortest(frozenset(x | y for x, y in product(a, b)))


def _shortest(q: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Query:
    """Every string must hold its own trigrams; a short one leaves nothing known."""
    return _shortest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)) if strings else NOTHING


def _walk(items: list) -> tuple[set[str] | None, Query]:
    """(strings that the sequence matches exactly, or None; query)."""
    known: set[str] | None = {""}
    query, whole = NOTHING, True
    for kind, arg in items:
        exact, own = _part(kind, arg)
        if exact is not None and known is not None and len(known) * len(exact) <= MOST_STRINGS:
            known = {a + b for a, b in product(known, exact)}
            continue
        query, whole = _both(query, _both(_of_strings(known or {""}), own)), False
        known = exact if exact is not None else {""}
    return (known, NOTHING) if whole else (None, _both(query, _of_strings(known or {""})))


def _part(kind: object, arg: object) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(arg).lower()}, NOTHING
    if kind is op.IN and all(k is op.LITERAL for k, _ in arg):
        return {chr(c).lower() for _, c in arg}, NOTHING
    if kind is op.SUBPATTERN:
        return _walk(arg[-1])
    if kind is op.BRANCH:
        exact, queries = set(), set()
        for branch in arg[1]:
            strings, q = _walk(branch)
            exact = exact | strings if exact is not None and strings is not None else None
            queries |= _of_strings(strings) if strings is not None else q
        return exact, _shortest(frozenset(queries))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = arg
        strings, q = _walk(body)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, NOTHING
        if least == 0:
            return None, NOTHING
        return None, _of_strings(strings) if strings is not None else q
    if kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
        return {""}, NOTHING
    return None, NOTHING


def trigram_query(pattern: str) -> Query:
    """The query of a pattern that Python and Java read alike; ``NOTHING`` if it has no mandatory trigram."""
    strings, query = _walk(list(parser.parse(re.sub(r"\(\?i:", "(?:", pattern))))
    return _of_strings(strings) if strings is not None else query
