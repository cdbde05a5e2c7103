"""What a text must hold to match a pattern, from the syntax tree of the pattern."""

from __future__ import annotations

from functools import cache
from re import IGNORECASE, _constants as op, _parser as parser
from re import error as PatternError

# Nodes that match no characters, so that what stands on both sides of them is adjacent.
EMPTY = (op.AT, op.ASSERT, op.ASSERT_NOT)
REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)
# Characters of a class that are worth one literal each.
CLASS_CHARS = 4
# Literals that are worth testing before a pattern.
MOST_LITERALS = 16

Literals = frozenset[str]


@cache
def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Literals one of which every match of ``pattern`` contains; None where that can't be shown.

    The longest are chosen, and of equals the fewest. A pattern that ignores case, or that this parser does not know, has none.
    """
    try:
        tree = parser.parse(pattern)
    except PatternError:
        return None
    if tree.state.flags & IGNORECASE:
        return None
    found = _of_sequence(list(tree))
    return tuple(sorted(found)) if found and len(found) <= MOST_LITERALS else None


def _worth(literals: Literals) -> tuple[int, int]:
    return min(map(len, literals)), -len(literals)


def _better(one: Literals | None, two: Literals | None) -> Literals | None:
    known = [x for x in (one, two) if x and min(map(len, x))]
    return max(known, key=_worth, default=None)


def _whole(nodes: list) -> Literals | None:
    """All the strings that a sequence can match, if they are few and it has no choice but characters and branches."""
    texts: Literals = frozenset([""])
    for kind, value in nodes:
        if kind is op.LITERAL:
            tails: Literals | None = frozenset([chr(value)])
        elif kind is op.IN:
            tails = _class(value)
        elif kind is op.SUBPATTERN and not value[1] & IGNORECASE:
            tails = _whole(list(value[3]))
        elif kind is op.BRANCH:
            branches = [_whole(list(b)) for b in value[1]]
            tails = None if None in branches else frozenset().union(*branches)
        elif kind in EMPTY:
            tails = frozenset([""])
        else:
            tails = None
        if tails is None or len(texts) * len(tails) > MOST_LITERALS:
            return None
        texts = frozenset(a + b for a in texts for b in tails)
    return texts


def _class(members: list) -> Literals | None:
    if len(members) > CLASS_CHARS or any(kind is not op.LITERAL for kind, _ in members):
        return None
    return frozenset(chr(value) for _, value in members)


def _of_sequence(nodes: list) -> Literals | None:
    """The best of the runs of nodes whose strings are all known, and of what single nodes need."""
    best, run = None, []
    for node in nodes:
        if _whole([*run, node]) is not None:
            run.append(node)
            continue
        best = _better(best, _whole(run))
        run = [node] if _whole([node]) is not None else []
        if not run:
            best = _better(best, _of_node(*node))
    return _better(best, _whole(run))


def _of_node(kind, value) -> Literals | None:
    if kind in REPEATS:
        return _of_sequence(list(value[2])) if value[0] else None
    if kind is op.SUBPATTERN:
        return None if value[1] & IGNORECASE else _of_sequence(list(value[3]))
    if kind is op.ATOMIC_GROUP:
        return _of_sequence(list(value))
    if kind is op.BRANCH:
        branches = [_of_sequence(list(b)) for b in value[1]]
        return None if None in branches else frozenset().union(*branches)
    return None
