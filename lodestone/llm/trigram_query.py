"""Boolean trigram queries that every match of a regular expression satisfies.

A query is True (anything may match), a trigram, or a tuple ("and" | "or", queries...). Letters are folded to lower case,
so an index over lower-cased text serves patterns of either case.
"""

from __future__ import annotations

from itertools import product
from re import _parser

Query = bool | str | tuple
#: More strings than this are not told apart.
MOST = 16


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if True in parts or not parts:
        return True
    held = {p: {p} if isinstance(p, str) else set(p[1:]) if p[0] == "and" else None for p in parts}
    # what asks for more than another option asks for adds nothing
    parts = [p for p in parts if held[p] is None or not any(held[q] is not None and held[q] < held[p] for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    """All trigrams of one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(node) -> tuple[set[str] | None, Query]:
    """The strings that a sequence can match, if they are few, or else None and a query."""
    strings: set[str] = {""}
    queries: list[Query] = []
    exact = True

    def flush() -> None:
        nonlocal strings, exact
        queries.append(_of_strings(strings))
        strings, exact = {""}, False

    for op, value in node:
        name = str(op)
        options, query = None, True
        if name == "LITERAL":
            options = {chr(value).lower()}
        elif name == "IN":
            options = _members(value)
        elif name == "SUBPATTERN":
            options, query = _walk(value[-1])
        elif name == "BRANCH":
            sides = [_walk(x) for x in value[1]]
            options = set().union(*(s for s, _ in sides)) if all(s is not None for s, _ in sides) else None
            query = _any([_of_strings(s) if s is not None else q for s, q in sides])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            found, inside = _walk(inner)
            if found is not None and int(most) <= 1:
                options = found | {""} if not least else found
            elif found is not None and least and len(found) ** min(int(least), 8) <= MOST:
                many = {"".join(x) for x in product(sorted(found), repeat=min(int(least), 8))}
                if int(most) == int(least) <= 8:
                    options = many
                else:  # the least number of times for certain; what follows isn't next to it
                    strings = {a + b for a, b in product(strings, many)}
                    flush()
                    continue
            elif least:
                query = inside
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if options is not None and len(options) * len(strings) <= MOST:
            strings = {a + b for a, b in product(strings, options)}
        else:
            flush()
            queries.append(_of_strings(options) if options is not None else query)
    if exact:
        return strings, _of_strings(strings)
    flush()
    return None, _all(queries)


def _members(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            found.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < 128:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST else None


def trigram_query(pattern: str) -> Query:
    """The query of a pattern; True if it has no trigram that every match must hold."""
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1:]))


def evaluate(query: Query, has) -> bool:
    """``has`` tells whether a trigram is there; its results may be Columns too."""
    if query is True or isinstance(query, str):
        return True if query is True else has(query)
    out = evaluate(query[1], has)
    for q in query[2:]:
        out = (out & evaluate(q, has)) if query[0] == "and" else (out | evaluate(q, has))
    return out
