"""Boolean trigram queries that every match of a regular expression must satisfy.

The expression's syntax tree is walked once on the driver. Each part yields either the exact lower-case
strings it can match (while they are few), or clauses that hold for whatever it matches. A clause is a set
of trigrams that must all occur; the clauses of a rule are alternatives. Case is folded, so the index
holds lower-case trigrams; a clause only ever admits too much, never too little.
"""

from __future__ import annotations

import re._constants as codes
import re._parser as parser

#: Strings kept exactly while walking, and clauses kept per rule; beyond it a part counts as unknown.
EXACT = 64


def _exact(tree) -> set[str] | None:
    """The strings that ``tree`` can match, if they are few and of known length."""
    found = {""}
    for op, arg in tree:
        if op is codes.LITERAL:
            part = {chr(arg).lower()}
        elif op is codes.SUBPATTERN:
            part = _exact(arg[3])
        elif op is codes.BRANCH:
            options = [_exact(x) for x in arg[1]]
            part = None if None in options else set().union(*options)
        elif op is codes.IN and len(arg) <= 8 and all(o is codes.LITERAL for o, _ in arg):
            part = {chr(c).lower() for _, c in arg}
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and arg[1] != codes.MAXREPEAT and arg[1] <= 4 and (inner := _exact(arg[2])) is not None:
            part = set()
            for times in range(arg[0], arg[1] + 1):
                built = {""}
                for _ in range(times):
                    built = {a + b for a in built for b in inner}
                part |= built
        elif op is codes.AT:
            part = {""}
        else:
            return None
        if part is None or len(found) * len(part) > EXACT:
            return None
        found = {a + b for a in found for b in part}
    return found


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _all_of(parts: list[set[frozenset[str]]]) -> set[frozenset[str]]:
    """Clauses of parts that must all hold: the part with the most selective alternatives first."""
    known = {frozenset()}
    for part in parts:
        if frozenset() in part or len(known) * len(part) > EXACT:
            continue
        known = {a | b for a in known for b in part}
    return known


def _clauses(tree) -> set[frozenset[str]]:
    parts, run = [], []
    for item in [*tree, None]:
        if item is not None and _exact([*run, item]) is not None:
            run.append(item)
            continue
        if run:
            parts.append({_grams(s) for s in _exact(run)})
            run = []
        if item is None:
            break
        op, arg = item
        if _exact([item]) is not None:
            run = [item]
        elif op is codes.SUBPATTERN:
            parts.append(_clauses(arg[3]))
        elif op is codes.BRANCH:
            parts.append(set().union(*(_clauses(x) for x in arg[1])))
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and arg[0] > 0:
            parts.append(_clauses(arg[2]))
    return _all_of(parts)


def trigram_query(pattern: str) -> list[tuple[str, ...]] | None:
    """Alternatives of trigrams that must occur together, or None where no trigram is mandatory."""
    clauses = _clauses(parser.parse(pattern))
    if not clauses or frozenset() in clauses:
        return None
    least = {c for c in clauses if not any(d < c for d in clauses)}
    return sorted(tuple(sorted(c)) for c in least)


def repeats_group(pattern: str) -> bool:
    """Whether anything but a single character or character class is repeated without a bound."""
    single = (codes.LITERAL, codes.NOT_LITERAL, codes.IN, codes.ANY)

    def inside(tree) -> bool:
        for op, arg in tree:
            if op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
                if arg[1] == codes.MAXREPEAT and not (len(arg[2]) == 1 and arg[2][0][0] in single) or inside(arg[2]):
                    return True
            elif op is codes.SUBPATTERN and inside(arg[3]):
                return True
            elif op is codes.BRANCH and any(inside(x) for x in arg[1]):
                return True
        return False

    return inside(parser.parse(pattern))
