"""Comments and strings of a file, and its text with them blanked out (same length, so offsets stay)."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from strataloom.sources.languages import LANGUAGES, Language


class Region(NamedTuple):
    kind: str  # comment, doc_comment, string_literal
    start: int
    end: int


class Masked(NamedTuple):
    text: str
    code: str  # comments and string contents blank
    bare: str  # comments blank, strings kept
    regions: list[Region]


#: Languages with pattern literals between slashes.
PATTERNS_BETWEEN_SLASHES = ("javascript", "jsx", "typescript", "tsx", "vue", "qml")
# what stands before a slash that begins a pattern: an operator, an opener or a word that no value ends with
_OPERATORS = "=(,:[!&|?{;>~^%+*<-"
_WORDS = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())


def _pattern_at(text: str, slash: int) -> bool:
    """Whether a slash begins a pattern and is no division."""
    at = slash
    while at and text[at - 1].isspace():
        at -= 1
    if not at or text[at - 1] in _OPERATORS:
        return True
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_$"):
        at -= 1
    return text[at:end] in _WORDS


@lru_cache(None)
def _scanner(name: str) -> re.Pattern | None:
    lang: Language = LANGUAGES[name]
    parts = []
    for i, (a, b) in enumerate(lang.block):
        parts.append(f"(?P<b{i}>{re.escape(a)})" if lang.nested else f"(?P<b{i}>{re.escape(a)}[\\s\\S]*?(?:{re.escape(b)}|\\Z))")
    for i, q in enumerate(lang.strings):
        if len(q) == 3:
            parts.append(f"(?P<s{i}>{q}(?:[^\\\\]|\\\\[\\s\\S])*?(?:{q}|\\Z))")
        elif q == "`":
            parts.append(f"(?P<s{i}>`(?:[^`\\\\]|\\\\[\\s\\S])*`)")
        elif q == "'" and name in ("rust", "c", "cpp", "go", "java", "csharp", "kotlin", "scala", "zig"):
            parts.append(f"(?P<s{i}>'(?:[^'\\\\\\n]|\\\\.[^'\\n]*)')")
        elif name == "sql":
            parts.append(f"(?P<s{i}>'(?:[^']|'')*')")
        else:
            parts.append(f"(?P<s{i}>{q}(?:[^{q}\\\\\\n]|\\\\[\\s\\S])*{q})")
    if name == "rust":
        parts.insert(0, r"""(?P<w>\bb?r(?P<h>\#*)"[\s\S]*?"(?P=h))""")
    if name in ("rust", "scala", "zig", "swift"):
        parts.append(r"(?P<c>'(?:[^'\\\n]|\\[^\n][^'\n]*)')")
    if name in PATTERNS_BETWEEN_SLASHES:
        parts.append(r"(?P<p>/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/)")
    for i, m in enumerate(sorted(lang.line, key=len, reverse=True)):
        lead = r"(?<![\w$])" if m in ("#", "'", "%") else ""
        parts.append(f"(?P<l{i}>{lead}{re.escape(m)}[^\\n]*)")
    return re.compile("|".join(parts)) if parts else None


def _nested_end(text: str, at: int, a: str, b: str) -> int:
    depth = 0
    for m in re.compile(f"{re.escape(a)}|{re.escape(b)}").finditer(text, at):
        depth += 1 if m[0] == a else -1
        if depth == 0:
            return m.end()
    return len(text)


_IN_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{|[{}]|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'")


def _template_end(text: str, start: int) -> int | None:
    """Where a template ends whose holes may hold templates; None where it does not end."""
    stack, at = ["`"], start + 1
    while m := _IN_TEMPLATE.search(text, at):
        t, at = m[0], m.end()
        inside = stack[-1] == "`"
        if t[0] in "\"'" and inside:
            at = m.start() + 1  # a quote in a template is text
        elif t == "`":
            if inside:
                stack.pop()
                if not stack:
                    return at
            else:
                stack.append("`")
        elif t == "${" and inside or t in ("{", "${") and not inside:
            stack.append("{")
        elif t == "}" and not inside:
            stack.pop()
    return None


def _blank(t: str) -> str:
    return re.sub(r"[^\n]", " ", t)


def mask(text: str, language: str) -> Masked:
    """Blanks comments (both texts) and string contents (``code``); damaged text is masked as far as it goes."""
    scan = _scanner(language)
    lang = LANGUAGES[language]
    if scan is None:
        return Masked(text, text, text, [])
    code, bare, regions, at = [], [], [], 0
    pos = 0
    while m := scan.search(text, pos):
        start, end, kind = m.start(), m.end(), m.lastgroup
        if kind == "p" and not _pattern_at(text, start):
            pos = start + 1  # a division
            continue
        if kind[0] == "b" and lang.nested:
            end = _nested_end(text, start, *lang.block[int(kind[1:])])
        elif kind[0] == "s" and text[start] == "`" and language in PATTERNS_BETWEEN_SLASHES:
            end = _template_end(text, start) or end
        pos = max(end, start + 1)
        plain = text[at:start]
        piece = text[start:end]
        code.append(plain)
        bare.append(plain)
        if kind[0] in "cpwh":
            # characters, patterns and raw strings: hidden between their first and last quotes
            a, b = (piece.index('"') + 1, piece.rindex('"')) if kind[0] in "wh" else (1, len(piece) - 1)
            code.append(piece[:a] + _blank(piece[a:b]) + piece[b:])
            bare.append(piece)
            if kind[0] in "wh":
                regions.append(Region("string_literal", start, end))
        elif kind[0] == "s":
            q = len(lang.strings[int(kind[1:])])
            inner = piece[q : max(q, len(piece) - q)]
            code.append(piece[:q] + _blank(inner) + piece[q + len(inner) :])
            bare.append(piece)
            regions.append(Region("string_literal", start, end))
        else:
            code.append(_blank(piece))
            bare.append(_blank(piece))
            doc = piece.startswith(lang.doc_line) if kind[0] == "l" and lang.doc_line else piece.startswith(("/**", "/*!")) and len(piece) > 4
            regions.append(Region("doc_comment" if doc else "comment", start, end))
        at = end
    code.append(text[at:])
    bare.append(text[at:])
    return Masked(text, "".join(code), "".join(bare), regions)
