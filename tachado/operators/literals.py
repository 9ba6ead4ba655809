"""What every match of a pattern must hold: literal parts, read off the pattern itself, so that texts without any are not scanned.

Looking for a few literals in a folded text costs a small part of running the pattern. The literals are read from the
pattern's parse tree, so this works for patterns given by a caller, too; a pattern without literals is always run.
"""

from __future__ import annotations

import re

#: Letters that a pattern may match without regard to case though lower() keeps them apart.
FOLD = {"ſ": "s", "ı": "i", "İ": "i"}
REPEATS = {"MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"}


def fold(text: str) -> str:
    if not text.isascii():
        for c, plain in FOLD.items():
            text = text.replace(c, plain)
    return text.lower()


def _worth(words: frozenset) -> tuple:
    return min(map(len, words)), -len(words)


def _of(items) -> frozenset | None:
    """Literals of which one at least stands in any match of these parts, one after the other; None if none is sure."""
    found, run = [], ""
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += fold(chr(value))
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inside = None
        if name == "SUBPATTERN":
            inside = _of(value[-1])
        elif name == "ATOMIC_GROUP":
            inside = _of(value)
        elif name == "ASSERT":
            inside = _of(value[1])
        elif name in REPEATS and value[0] >= 1:
            inside = _of(value[2])
        elif name == "BRANCH":
            parts = [_of(p) for p in value[1]]
            inside = frozenset().union(*parts) if all(parts) else None
        if inside:
            found.append(inside)
    if run:
        found.append(frozenset([run]))
    return max(found, key=_worth, default=None)


def needed(pattern: re.Pattern) -> tuple[str, ...]:
    """Literals, folded, of which one at least stands in every text that the pattern matches; empty if unknown."""
    try:
        from re import _parser
    except ImportError:  # another interpreter: no guard, same results
        return ()
    words = _of(_parser.parse(pattern.pattern, pattern.flags))
    return tuple(sorted(words, key=len)) if words and len(words) <= 40 else ()


def may_match(words: tuple[str, ...], folded: str) -> bool:
    return not words or any(w in folded for w in words)
