"""Boolean trigram queries from regular expressions.

A query is a trigram, a tuple ("and" | "or", queries), or True, which every text satisfies. The query of a regex
is satisfied by every text that holds a match of it; letters A-Z are folded to a-z on both sides. It is read off
the parsed regex: a concatenation is the conjunction of what its parts ask for, an alternation the disjunction.
Parts with a bounded set of texts (literals, small classes, alternatives and optional parts of these) are joined
to runs first, so that trigrams may span them; a part that may be empty or anything ends a run.
"""
from __future__ import annotations

import re
from re import _constants as op
from re import _parser

#: Most characters of a class, and most texts of a run, that are listed.
CLASS, RUN = 8, 64


def folded(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def both(a, b):
    """The conjunction of two queries."""
    if a is True or b is True:
        return b if a is True else a
    parts = [*(a[1] if a[0] == "and" else (a,)), *(b[1] if b[0] == "and" else (b,))]
    return ("and", tuple(dict.fromkeys(parts)))


def either(queries):
    """The disjunction of some queries; one that asks for all that another asks for, and more, adds nothing."""
    if any(q is True for q in queries):
        return True
    asked = {q: frozenset(q[1]) if q[0] == "and" else frozenset([q]) for q in queries}
    parts = tuple(q for q in asked if not any(other < asked[q] for other in asked.values()))
    return parts[0] if len(parts) == 1 else ("or", parts)


def of_text(text: str):
    """All trigrams of a text."""
    out = True
    for i in range(len(text) - 2):
        out = both(out, ("and", (text[i:i + 3],)))
    return out[1][0] if out is not True and len(out[1]) == 1 else out


def of_texts(texts: frozenset[str]):
    """Any of some texts, each with all its trigrams."""
    return either([of_text(t) for t in sorted(texts)])


def _members(items) -> frozenset[str] | None:
    """The folded characters of a class, None for many or for those that a negation or a category gives."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(folded(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < 64:
            out |= {folded(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= CLASS else None


def _part(kind, value) -> tuple[frozenset[str] | None, object]:
    """(texts, query) of a node: all its texts, where they can be listed, else what each of its texts satisfies."""
    if kind is op.LITERAL:
        return frozenset([folded(chr(value))]), True
    if kind is op.IN:
        return _members(value), True
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):  # no width; an assertion only takes matches away
        return frozenset([""]), True
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind is op.BRANCH:
        options = [_sequence(p) for p in value[1]]
        if all(t is not None for t, _ in options) and len(texts := frozenset().union(*(t for t, _ in options))) <= RUN:
            return texts, True
        return None, either([q if t is None else of_texts(t) for t, q in options])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value
        texts, query = _sequence(inner)
        if low == 0:
            return (texts | {""}, True) if high == 1 and texts is not None else (None, True)
        if texts is None:
            return None, query
        every, n = frozenset([""]), 0
        while n < low and len(every) * len(texts) <= RUN:
            every, n = frozenset(a + b for a in every for b in texts), n + 1
        return (every, True) if n == low == high else (None, of_texts(every))
    return None, True  # any character, back references, conditions


def _sequence(nodes) -> tuple[frozenset[str] | None, object]:
    query, run, whole = True, frozenset([""]), True
    for kind, value in nodes:
        texts, own = _part(kind, value)
        if texts is not None and len(run) * len(texts) <= RUN:
            run = frozenset(a + b for a in run for b in texts)
            continue
        query, whole = both(both(query, of_texts(run)), own), False
        run = texts if texts is not None else frozenset([""])
    return (run, True) if whole else (None, both(query, of_texts(run)))


def trigram_query(regex: str):
    """The query of a regex; True, which means a scan, for one without mandatory trigrams or beyond the parser."""
    try:
        texts, query = _sequence(_parser.parse(regex))
    except re.error:
        return True
    return query if texts is None else of_texts(texts)


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def satisfied(query, text: str) -> bool:
    """Whether a text satisfies a query."""
    text = folded(text)

    def holds(q) -> bool:
        return q in text if isinstance(q, str) else q is True or (all if q[0] == "and" else any)(map(holds, q[1]))

    return holds(query)
