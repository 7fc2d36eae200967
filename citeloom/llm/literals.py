"""Literals that any match of a regular expression must contain, read off its syntax tree."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser


def _sets(tree, least: int) -> set[str] | None:
    """Texts of which every match holds at least one, `least` characters each at least; None if there are none to rely on."""
    best: set[str] | None = None
    run = ""

    def offer(x: set[str] | None) -> None:
        nonlocal best
        if x and min(map(len, x)) >= least and (best is None or (min(map(len, x)), -len(x)) > (min(map(len, best)), -len(best))):
            best = x

    for op, av in tree:
        if op is C.LITERAL:
            run += chr(av)
            continue
        if run:
            offer({run})
            run = ""
        if op is C.SUBPATTERN:
            offer(_sets(av[3], least))
        elif op is C.BRANCH:
            parts = [_sets(x, least) for x in av[1]]
            offer(set().union(*parts) if all(parts) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and av[0] >= 1:
            offer(_sets(av[2], least))
        elif op is C.ATOMIC_GROUP:
            offer(_sets(av, least))
    if run:
        offer({run})
    return best


def needed_literals(pattern: str, flags: int = 0, least: int = 2) -> set[str]:
    """Lower-case texts of which any match of the pattern contains one, ignoring case; empty if the pattern can match without."""
    return {x.lower() for x in _sets(parser.parse(pattern, flags), least) or ()}
