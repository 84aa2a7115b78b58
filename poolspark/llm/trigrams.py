"""Boolean trigram queries of regular expressions.

A query is a list of alternatives, each a set of lower-case trigrams a matching text must all contain. An
empty list means that the expression has no mandatory trigram.
"""

from __future__ import annotations


from re import _constants as op
from re import _parser

#: Alternatives kept while strings are put together; beyond it a part counts as unknown, which only widens a query.
MOST = 64
GAP = "\0"  # stands for text of unknown content and length


def trigram_query(pattern: str) -> list[frozenset[str]]:
    found = []
    for text in _strings(_parser.parse(pattern)):
        grams = {part[i:i + 3] for part in text.lower().split(GAP) for i in range(len(part) - 2)}
        if not grams:
            return []
        found.append(frozenset(grams))
    smallest = [g for g in set(found) if not any(other < g for other in found)]
    return sorted(smallest, key=sorted)


def _strings(parts) -> list[str]:
    """Every way to write the fixed parts of a match, up to MOST."""
    out = [""]
    for kind, value in parts:
        own = _part(kind, value)
        out = list(dict.fromkeys(a + b for a in out for b in own)) if len(out) * len(own) <= MOST else [a + GAP for a in out]
    return out


def _part(kind, value) -> list[str]:
    if kind is op.LITERAL:
        return [chr(value)]
    if kind is op.SUBPATTERN:
        return _strings(value[3])
    if kind is op.BRANCH:
        return [s for branch in value[1] for s in _strings(branch)]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, item = value
        if (low, high) == (0, 1):
            return ["", *_strings(item)]
        if low == 0:
            return [GAP]
        own = _strings(item)
        return own if high == 1 else [s + GAP + s if low > 1 else s + GAP for s in own] if len(own) == 1 else [GAP + s + GAP for s in own]
    if kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
        return [""]
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 4:
        return [chr(c) for _, c in value]
    return [GAP]


def holds(pattern: str, text: str) -> bool:
    """Whether the query lets ``text`` through; used by tests."""
    query = trigram_query(pattern)
    return not query or any(all(g in text.lower() for g in grams) for grams in query)


