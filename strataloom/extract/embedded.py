"""Blocks and expressions of other languages in markup: where they lie, and what their rows add to their host's."""

from __future__ import annotations

import re

_BLOCK = re.compile(r"<(script|style)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?<!/)>([\s\S]*?)</\1\s*>", re.I)
_COMMENT = re.compile(r"<!--[\s\S]*?(?:-->|\Z)")
_LANG = re.compile(r"\b(lang|type)\s*=\s*[\"']?([\w./+-]+)", re.I)
# What a script's or style's lang or type says its language is.
GUESTS = {
    "ts": "typescript", "typescript": "typescript", "tsx": "tsx", "jsx": "jsx", "js": "javascript", "javascript": "javascript", "module": "javascript", "text/javascript": "javascript",
    "application/javascript": "javascript", "text/ecmascript": "javascript", "application/json": "json", "application/ld+json": "json", "importmap": "json", "css": "css", "text/css": "css",
}
_INTERPOLATION = re.compile(r"\{\{([\s\S]*?)\}\}")
_BOUND = re.compile(r"\s(@[\w:.-]+|v-on:[\w:.-]+|:[\w.-]+|v-bind:[\w.-]+|v-[\w.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_HANDLER = re.compile(r"\s(on[a-z]+)\s*=\s*(\"[^\"]*\"|'[^']*')", re.I)
_PATH = re.compile(r"\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\Z")


def blocks(text: str) -> list[tuple[str, int, int]]:
    """The guest blocks outside comments: language, start and end of their text. Unknown languages are left to the host."""
    plain = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for m in _BLOCK.finditer(plain):
        said = _LANG.search(m[2])
        guest = GUESTS.get(said[2].lower()) if said else "javascript" if m[1].lower() == "script" else "css"
        if guest and m[3].strip():
            out.append((guest, m.start(3), m.end(3)))
    return out


def expressions(host: str, language: str) -> list[tuple[int, int, bool]]:
    """The script expressions in a host's attributes and interpolations: start, end, and whether a mere name is called."""
    out = [(m.start(1), m.end(1), False) for m in _INTERPOLATION.finditer(host)] if language == "vue" else []
    for m in (_BOUND if language == "vue" else _HANDLER).finditer(host):
        a, b = m.start(2) + 1, m.end(2) - 1
        called = (m[1].startswith(("@", "v-on:")) or language == "html") and bool(_PATH.match(host, a, b))
        out.append((a, b, called))
    return sorted(out)


def without(text: str, parts: list[tuple[int, int]]) -> str:
    """The text with parts blanked, line breaks kept, so that all offsets stay."""
    out, at = [], 0
    for a, b in parts:
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def merge(host: dict[str, list[dict]], guest: dict[str, list[dict]]) -> None:
    """Adds a guest's rows to its host's; of its file metrics the counts are folded into the host's file row."""
    files = [c for c in host["complexity_metrics"] if c["scope"] == "file"]
    for family, rows in guest.items():
        if family == "complexity_metrics" and files:
            for r in rows:
                if r["scope"] != "file":
                    continue
                for c in ("decision_count", "loop_count"):
                    files[0][c] += r[c]
                files[0]["max_nesting_depth"] = max(files[0]["max_nesting_depth"], r["max_nesting_depth"])
            rows = [r for r in rows if r["scope"] != "file"]
        host[family] += rows
