"""What a regex needs: literals that a text must hold to match, found from the regex itself.

A search for a literal costs a fraction of a regex search, so a long text is sought for literals first, and the regex runs
only where they leave it open. Regexes are taken as case-sensitive, unanchored searches.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as sre
from re import _parser as parser

#: Pieces of an alternative that aren't literals: one that may be empty, and one that may not.
MAYBE, OTHER = object(), object()
#: Beyond this many alternatives a part counts as OTHER: the filter is weaker, the result the same.
MOST = 200


def _merge(pieces) -> tuple:
    out: list = []
    for p in pieces:
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        elif p != "":
            out.append(p)
    return tuple(out)


def _alternatives(tree) -> list[tuple]:
    """The ways to match a parsed regex, each as literals and gaps in order."""
    found: list[tuple] = [()]
    for op, arg in tree:
        if op is sre.LITERAL:
            ways = [(chr(arg),)]
        elif op is sre.IN and len(arg) <= 4 and all(o is sre.LITERAL for o, _ in arg):
            ways = [(chr(c),) for _, c in arg]
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            ways = _alternatives(arg[3])
        elif op is sre.BRANCH:
            ways = [w for branch in arg[1] for w in _alternatives(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            ways = [(MAYBE,)] if arg[0] == 0 else _alternatives(arg[2]) if arg[:2] == (1, 1) else [(*w, MAYBE) for w in _alternatives(arg[2])] if arg[0] == 1 else [(OTHER,)]
        else:
            ways = [(OTHER,)]
        if len(found) * len(ways) > MOST:
            ways = [(OTHER,)]
        found = [_merge(a + b) for a, b in product(found, ways)]
    return found


def _fewest(words: set[str]) -> list[str]:
    """The words that hold no other one: a text with any of the words has one of these."""
    return sorted(w for w in words if not any(v != w and v in w for v in words))


def factors(regex: str) -> tuple[list[str], list[list[str]] | None]:
    """(enough, needed): a text with any literal of enough matches; any other match has a literal of each list of needed.

    needed is empty where nothing is known, and None where enough alone decides.
    """
    enough, rest = set(), []
    for way in _alternatives(parser.parse(re.sub(r"\\[pP]\{\w+\}", r"\\w", regex))):
        while way and way[0] is MAYBE:
            way = way[1:]
        while way and way[-1] is MAYBE:
            way = way[:-1]
        if len(way) == 1 and isinstance(way[0], str):
            enough.add(way[0])
        else:
            rest.append([p for p in way if isinstance(p, str)])
    rest = [r for r in rest if not any(e in p for e in enough for p in r)]
    if not rest:
        return _fewest(enough), None
    if not all(rest):
        return _fewest(enough), []
    sides = [_fewest({r[0] for r in rest}), _fewest({r[-1] for r in rest})]
    return _fewest(enough), sorted((s for k, s in enumerate(sides) if s not in sides[:k]), key=len)
