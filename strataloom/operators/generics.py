"""Brackets of masked code, the items they hold, and nested type arguments flattened in pre-order."""

from __future__ import annotations

import bisect
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Languages that write type arguments in angle brackets; in the others ``<`` only compares.
ANGLE = frozenset("rust zig typescript tsx javascript jsx vue java csharp razor swift kotlin dart cpp fsharp php".split())
#: Languages that write them in square brackets, as they do indices.
SQUARE = frozenset(("python", "go", "scala"))
# Go's own types, by which an argument in lower case is a type and no index.
GO_TYPES = frozenset(
    "any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split()
)
#: Of these, the languages where ``f(a<b, c>d)`` always compares.
COMPARES = frozenset(("javascript", "jsx", "vue", "php", "zig"))
_TOKENS = re.compile(r"\\.|'[()\[\]{}<>,;]'|[-=]>|<[<=-]|&&|\|\||[()\[\]{}<>,;+/%^]")
_OPENER = {")": "(", "]": "[", "}": "{"}
_SOLID = re.compile(r"\S")
_NAME = regex.compile(r"[\p{L}_$][\p{L}\p{N}_$]*(?:(?:\.|::)[\p{L}_$][\p{L}\p{N}_$]*)*")
# commas that part no arguments: closure and lambda parameters, targets of comprehensions
_BINDERS = {
    "rust": re.compile(r"(?:[(,=]|\bmove|\breturn)\s*\|[^|;{}]*\|"),
    "python": re.compile(r"\blambda\b[^:()\[\]{}]*:|\bfor\b[^()\[\]{}:]*?\bin\b"),
}


class Brackets:
    """Partners, separators and enclosing brackets of every position, from one pass over a file's masked code.

    A closer without its opener is passed over; one that closes an outer bracket leaves the inner ones open. Angle
    brackets count where they follow a name (or ``::``) and are closed before anything that no type holds.
    """

    def __init__(self, code: str, language: str):
        self.code, self.language = code, language
        self.close: dict[int, int] = {}
        self.commas: dict[int, list[int]] = {}
        self.inner: dict[int, list[int]] = {}
        self._marks: list[int] = []
        self._around: list[int] = []
        angles = language in ANGLE
        binders = _BINDERS.get(language)
        bound = {c.start() for b in binders.finditer(code) for c in re.compile(",").finditer(code, b.start() + 1, b.end())} if binders else ()
        stack: list[tuple[str, int]] = []
        solid: list[int] = []
        held = {"(": 0, "[": 0, "{": 0}

        def mark(at: int) -> None:
            self._marks.append(at)
            self._around.append(solid[-1] if solid else -1)

        def drop() -> None:
            """An angle bracket that only compares: what it held belongs to the bracket around it."""
            _, at = stack.pop()
            commas, inner = self.commas.pop(at, []), self.inner.pop(at, [])
            if stack:
                self.commas.setdefault(stack[-1][1], []).extend(commas)
                self.inner.setdefault(stack[-1][1], []).extend(inner)

        for t in _TOKENS.finditer(code):
            c, at = t[0], t.start()
            if c in held:
                stack.append((c, at))
                solid.append(at)
                held[c] += 1
                mark(at)
            elif c in _OPENER:
                if not held[_OPENER[c]]:
                    continue
                while stack:
                    if stack[-1][0] == "<":
                        drop()
                        continue
                    kind, start = stack.pop()
                    solid.pop()
                    held[kind] -= 1
                    if kind == _OPENER[c]:
                        self.close[start] = at
                        if kind == "[" and language in SQUARE and stack:
                            self.inner.setdefault(stack[-1][1], []).append(start)
                        break
                mark(at)
            elif c == ",":
                if stack and at not in bound:
                    self.commas.setdefault(stack[-1][1], []).append(at)
            elif c == "<":
                before = code[at - 1 : at]
                if angles and at and (before.isalnum() or before in "_$" or code[at - 2 : at] == "::"):
                    stack.append((c, at))
            elif c == ">":
                if stack and stack[-1][0] == "<":
                    start = stack[-1][1]
                    if self._generic(start, at):
                        stack.pop()
                        self.close[start] = at
                        if stack:
                            self.inner.setdefault(stack[-1][1], []).append(start)
                    else:
                        drop()
            elif c in (";", "&&", "||", "+", "/", "%", "^") and not (c in ("&&", "+") and language in ("rust", "cpp")):
                while stack and stack[-1][0] == "<":
                    drop()
        while stack:
            if stack[-1][0] == "<":
                drop()
            else:
                stack.pop()

    def _generic(self, start: int, end: int) -> bool:
        """Whether a pair holds types: after ``::`` or a name in capitals, or before what follows types alone."""
        code, after = self.code, self.code[end + 1 : end + 2]
        if after.isalnum():
            return False
        if code[start - 2 : start] == "::" or (after in ("(", "{", ">", ":") and self.language not in COMPARES):
            return True
        at = start
        while at and (code[at - 1].isalnum() or code[at - 1] in "_$"):
            at -= 1
        return code[at].isupper()

    def enclosing(self, at: int) -> int:
        """The innermost open bracket (no angle bracket) around a position, or -1."""
        i = bisect.bisect_left(self._marks, at) - 1
        return self._around[i] if i >= 0 else -1

    def position(self, opener: int, at: int) -> int:
        """How many separators of a bracket lie before a position."""
        return bisect.bisect_left(self.commas.get(opener, ()), at)

    def typed(self, end: int) -> bool:
        """Whether type arguments follow a name that ends here (after ``::``, too)."""
        at = end + 2 if self.code[end : end + 3] == "::<" else end
        return at in self.close and self.code[at] == "<"

    def square(self, opener: int, text: str) -> bool:
        """Whether a square bracket after a name in capitals holds types and no index: in Scala always, elsewhere by its items."""
        if self.language not in SQUARE or self.code[opener : opener + 1] != "[" or opener not in self.close:
            return False
        if self.language == "scala":
            return True
        cuts = [opener, *sorted(self.commas.get(opener, ())), self.close[opener]]
        for a, z in zip(cuts, cuts[1:]):
            arg = text[a + 1 : z].strip()
            if not arg and z == self.close[opener]:
                continue
            if self.language == "python":
                if not re.match(r"[A-Za-z_\[\"'.]", arg) or ":" in arg or "(" in arg:
                    return False
            elif not (arg.startswith(("*", "[]", "map[", "func(", "chan ", "struct{", "interface{")) or re.split(r"[\[{.]", arg)[0] in GO_TYPES or re.match(r"(?:\w+\.)?[A-Z]", arg)):
                return False
        return len(cuts) > 2 or bool(text[opener + 1 : self.close[opener]].strip())

    def items(self, opener: int) -> int | None:
        """The number of items in a bracket (a trailing separator adds none), or None where it is not closed."""
        end = self.close.get(opener)
        if end is None:
            return None
        commas = self.commas.get(opener, ())
        return len(commas) + bool(_SOLID.search(self.code, commas[-1] + 1 if commas else opener + 1, end))


def type_arguments(b: Brackets, text: str, opener: int) -> tuple[list[tuple[str | None, str, int, str]], set[int]]:
    """The arguments of the angle (or square) bracket at ``opener`` in pre-order, and the nested brackets among them.

    Each is (path of the parent or None, path, ordinal, type name). A generic argument is named without its own
    arguments, which follow it; any other argument is its whole text. Lifetimes are no types and have no ordinal.
    """
    rows: list[tuple[str | None, str, int, str]] = []
    nested: set[int] = set()
    todo: list[tuple] = [("list", opener, None)]
    while todo:
        kind, at, parent, *row = todo.pop()
        if kind == "row":
            rows.append((parent, row[0], row[1], row[2]))
            continue
        commas, inner = sorted(b.commas.get(at, ())), sorted(b.inner.get(at, ()))
        cuts = [at, *commas, b.close[at]]
        more: list[tuple] = []
        ordinal = 0
        for a, z in zip(cuts, cuts[1:]):
            raw = text[a + 1 : z]
            arg = raw.strip()
            if not arg or (b.language == "rust" and (arg == "_" or re.fullmatch(r"'\w+", arg))):
                continue
            last = a + 1 + len(raw.rstrip()) - 1
            i = bisect.bisect_left(inner, a)
            child = inner[i] if i < len(inner) and inner[i] < z and b.close[inner[i]] == last else None
            name = text[a + 1 : child].strip().removesuffix("::") if child is not None else arg
            if child is not None and not _NAME.fullmatch(name):
                child, name = None, arg
            path = f"{parent}.{ordinal}" if parent is not None else str(ordinal)
            more.append(("row", 0, parent, path, ordinal, name))
            if child is not None:
                nested.add(child)
                more.append(("list", child, path))
            ordinal += 1
        todo += reversed(more)
    return rows, nested


def flatten_type(text: str, language: str = "java") -> list[tuple[str | None, str, int, str]]:
    """One type's text as the rows of ``type_arguments``, the type itself first, at path 0."""
    code = f"T<{text}>"
    b = Brackets(code, language)
    return type_arguments(b, code, 1)[0] if b.close.get(1) == len(code) - 1 else [(None, "0", 0, text.strip())]


def flatten(df: DataFrame, col: str, language: str = "java") -> DataFrame:
    """Adds ``parent`` (empty for the type itself), ``path``, ``ordinal`` and ``type_name``: a row for every type in the texts of a column.

    Null and blank texts give no row.
    """

    @F.udf("array<struct<parent string, path string, ordinal long, type_name string>>")
    def rows(t: str | None) -> list[tuple] | None:
        return [(p or "", *r) for p, *r in flatten_type(t, language)] if t and t.strip() else None

    return df.select(*df.columns, F.explode(rows(F.col(col))).alias("r")).select(*df.columns, "r.*")
