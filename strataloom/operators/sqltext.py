"""Relations between the tables of an SQL text: joins, foreign keys, and the clauses of a SELECT."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = r"(?:[\"`\[]?[\w$]+[\"`\]]?\.)*[\"`\[]?[\w$]+[\"`\]]?"
_WORDS = re.compile(rf"\b(create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?|alter\s+table\s+(?:only\s+)?|from\s+|join\s+|references\s+)({_NAME})|[();]|\bselect\b", re.I)
_CLAUSE = re.compile(r"[();]|\b(where|group|order)\b", re.I)


def bare(name: str) -> str:
    """The last part of a name, without quotes, in lower case."""
    return re.sub(r"[\"`\[\]]", "", name.rpartition(".")[2]).lower()


def table_edges(code: str) -> Iterator[tuple[str, str, str, int, int]]:
    """Joins and foreign keys in masked SQL: kind, from, to, start and end of the name that says so.

    A join goes from the first relation of its FROM clause to the joined one, at the same depth of brackets; a foreign
    key from the table whose definition or alteration holds it to the referenced one.
    """
    depth, owner = 0, None
    first: dict[int, str | None] = {}
    for m in _WORDS.finditer(code):
        t = m[0].lower()
        if t == "(":
            depth += 1
            first[depth] = None
        elif t == ")":
            depth = max(0, depth - 1)
        elif t == ";":
            depth, owner, first = 0, None, {}
        elif t == "select":
            first[depth] = None
        else:
            word, name = m[1].split()[0].lower(), bare(m[2])
            if word in ("create", "alter"):
                owner = name
            elif word == "from":
                if first.get(depth) is None:
                    first[depth] = name
            elif word == "join" and first.get(depth):
                yield "joins", first[depth], name, m.start(2), m.end(2)
            elif word == "references" and owner:
                yield "references", owner, name, m.start(2), m.end(2)


def select_flags(code: str, start: int) -> dict[str, bool]:
    """Whether the SELECT at a position of masked SQL has WHERE, GROUP BY and ORDER BY of its own, not of a subquery."""
    flags = {"has_where": False, "has_group_by": False, "has_order_by": False}
    depth = 0
    for m in _CLAUSE.finditer(code, start):
        t = m[0].lower()
        if t == "(":
            depth += 1
        elif t == ")":
            if depth == 0:
                break
            depth -= 1
        elif t == ";":
            if depth == 0:
                break
        elif depth == 0:
            flags[{"where": "has_where", "group": "has_group_by", "order": "has_order_by"}[t]] = True
    return flags
