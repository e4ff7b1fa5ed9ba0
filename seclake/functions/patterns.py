"""Words that a text must hold before a pattern can match it."""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op, _parser

MOST_WORDS = 16
_SAFE_FLAGS = re.IGNORECASE | re.MULTILINE | re.DOTALL | re.UNICODE


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The choice whose shortest word is longer; of equals the one with fewer words."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda words: (min(map(len, words)), -len(words)))


def _of_sequence(items) -> list[str] | None:
    best, run = None, ""
    for kind, value in [*items, (None, None)]:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind is op.AT:  # takes no letters
            continue
        if run:
            best, run = _better(best, [run]), ""
        best = _better(best, _of_item(kind, value))
    return best


def _of_item(kind, value) -> list[str] | None:
    if kind is op.SUBPATTERN:
        _, added, _, inside = value
        return None if added & ~_SAFE_FLAGS else _of_sequence(inside)
    if kind is op.ATOMIC_GROUP:
        return _of_sequence(value)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, _, inside = value
        return _of_sequence(inside) if least else None
    if kind is op.BRANCH:
        ways = [_of_sequence(way) for way in value[1]]
        if any(way is None for way in ways):
            return None
        words = list(dict.fromkeys(word for way in ways for word in way))
        return words if len(words) <= MOST_WORDS else None
    if kind is op.IN:
        letters = [v for k, v in value if k is op.LITERAL]
        if len(letters) == len(value) <= 4 and all(v < 128 for v in letters):
            return list(dict.fromkeys(chr(v).lower() for v in letters))
    return None


@lru_cache(maxsize=10_000)
def needed_words(pattern: str) -> tuple[str, ...] | None:
    """Words in lower case of which every match holds one; None if that can't be told.

    Worked out from the parsed pattern: runs of letters that can't be left out, all branches
    of a choice together. Patterns are matched without case by another engine: what this parser
    does not know, or marks with unusual flags, has no words.
    """
    try:
        parsed = _parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None
    if parsed.state.flags & ~_SAFE_FLAGS:
        return None
    words = _of_sequence(parsed)
    return None if words is None else tuple(words)
