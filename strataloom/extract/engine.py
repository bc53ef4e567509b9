"""From a file's text to its row families: one pass a file, many files a task.

``extract_file`` is plain Python over one file; ``extract`` runs it in Arrow batches over a DataFrame of snapshots
and gives one row a file with an array of structs for each family; ``family`` explodes one of them. Output does not
depend on how files are spread.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import json
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.artifact.schema import FAMILIES, FOREIGN_KEYS, TABLES
from strataloom.extract import embedded
from strataloom.extract import patterns as P
from strataloom.extract.comments import markers
from strataloom.extract.declarations import CALLABLE, DECISIONS, DECLARATIONS, KEYWORDS, LOOPS
from strataloom.extract.mask import Masked, mask
from strataloom.extract.policies import POLICIES, Policy, classify
from strataloom.functions.ids import SEPARATOR
from strataloom.operators.generics import Brackets, type_arguments
from strataloom.operators.reports import level_families
from strataloom.operators.spans import KIND_RANK
from strataloom.operators.sqltext import bare, table_edges
from strataloom.session import spread
from strataloom.sources.languages import LANGUAGES

#: Deepest nesting that is still counted.
DEPTH = 1024
_WORD = regex.compile(r"[\p{L}_$][\p{L}\p{N}_$]*")
_ASSIGN = re.compile(r"\s*(=(?![=>])|[-+*/%&|^]=|\+\+|--|<<=|>>=|:=)")
_CARRIER = regex.compile(r"(?r)[\p{L}\p{N}_$.:>-]+")
_RECEIVER = regex.compile(r"(?r)([\w$]+)(?:\.|::|->)")
_STARTER = regex.compile(r"[\p{L}_$]")
_NOT_SPACE = regex.compile(r"(?r)\S")
_NAMED_ARGUMENT = re.compile(r"([A-Za-z_]\w*)\s*(?:=(?![=>])|:(?!:)(?=\s))")
_PARAMS = re.compile(r"[,;]")
_NAMED_TYPE = re.compile(r"(?:[:<,]|->|\bnew|\bextends|\bimplements|\bas|\binstanceof|\bis)\s*$")
# Names of test calls and their role.
TEST_CALLS = {
    "describe": "container", "context": "container", "suite": "container", "it": "case", "test": "case", "specify": "case",
    "beforeEach": "setup", "beforeAll": "setup", "before": "setup", "afterEach": "teardown", "afterAll": "teardown", "after": "teardown",
}


def stable(prefix: str, *parts: object) -> str:
    text = SEPARATOR.join(["" if p is None else str(p) for p in parts] + [""])
    return f"{prefix}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"


@lru_cache(1 << 14)
def _told(*items: tuple) -> str:
    """The metadata of an identifier: the same few, again and again."""
    return json.dumps(dict(items), sort_keys=True)


_FACT = json.JSONEncoder(sort_keys=True, ensure_ascii=False).encode


class Lines:
    """Offsets of a text: characters to bytes, lines (from 1) and columns (bytes, from 0).

    ``line`` and ``base``: the lines and bytes of its file before the text; ``column``: the bytes before it on its line.
    """

    def __init__(self, text: str, line: int = 0, base: int = 0, column: int = 0):
        self.line, self.base, self.column = line, base, column
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()
        self.bytes = None
        if not self.ascii:
            import numpy as np

            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            widths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            self.bytes = [0, *np.cumsum(widths).tolist()]

    def byte(self, at: int) -> int:
        return self.base + (at if self.bytes is None else self.bytes[at])

    def span(self, start: int, end: int, prefix: str = "") -> dict:
        starts, widths = self.starts, self.bytes
        first, last = bisect.bisect_right(starts, start), bisect.bisect_right(starts, end)
        a, z, from_, to = start, end, starts[first - 1], starts[last - 1]
        if widths is not None:
            a, z, from_, to = widths[a], widths[z], widths[from_], widths[to]
        out = {
            "start_line": self.line + first, "start_column": a - from_ + (self.column if first == 1 else 0), "start_byte": self.base + a,
            "end_line": self.line + last, "end_column": z - to + (self.column if last == 1 else 0), "end_byte": self.base + z,
        }
        return {prefix + k: v for k, v in out.items()} if prefix else out


@lru_cache(None)
def _compiled(language: str) -> list[tuple[str, regex.Pattern]]:
    return [(k, regex.compile(p, regex.M)) for k, p in DECLARATIONS[language]]


def partners(code: str) -> dict[int, int]:
    """Every opening bracket's closing one, in one pass over masked code."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"[(){}\[\]]", code):
        if m[0] in "({[":
            stack.append((m[0], m.start()))
        elif stack and stack[-1][0] + m[0] in ("()", "{}", "[]"):
            out[stack.pop()[1]] = m.start()
    return out


#: Languages in which only a semicolon ends a statement.
SEMICOLON = frozenset("java rust c cpp csharp php dart zig".split())
_STOPS = re.compile(r"[;,\n(){}\[\]]")


def statement_end(code: str, at: int, close: dict[int, int], language: str) -> int:
    """Where a declaration without body ends: with its semicolon, or before the line break or bracket that ends it."""
    data = LANGUAGES[language].family == "data"
    while m := _STOPS.search(code, at):
        c, i = m[0], m.start()
        if c == ";" and not data:
            return m.end()
        if c in "({[":
            if i not in close:
                return len(code[:i].rstrip())
            at = close[i] + 1
            continue
        going_on = code[:i].rstrip()[-1:] in ("=", ",", "+", "-", "*", "/", "&", "|", "?", ":", "<", ".")
        ends = c in ")}]" or (c == "," and language == "json") or (c == "\n" and language != "json" and language not in SEMICOLON and not (going_on and not data))
        if ends:
            return len(code[:i].rstrip())
        at = m.end()
    return len(code.rstrip())


def config_values(m: Masked, language: str, found: list[dict]) -> Iterator[tuple[int, int, str]]:
    """The strings that are values of a configuration's keys: start, end and the dotted path of keys.

    An object in an array has its index in brackets for a key.
    """
    strings = {r.start: r.end for r in m.regions if r.kind == "string_literal"}
    if language == "json":
        frames: list[list] = []  # opener, path, key or index
        for t in re.finditer(r'["{}\[\],:]', m.code):
            c, at = t[0], t.start()
            top = frames[-1] if frames else None
            if c == '"' and at in strings:
                if top and top[0] == "{":
                    if top[3]:
                        yield at, strings[at], ".".join(filter(None, (top[1], top[2]))).replace(".[", "[")
                    else:
                        top[2] = unquoted(m.text[at : strings[at]])
            elif c in "{[":
                path = "" if top is None else ".".join(filter(None, (top[1], top[2] if top[0] == "{" else f"[{top[2]}]" if c == "{" else "")))
                frames.append([c, path, "" if c == "{" else 0, False])
            elif c in "}]" and frames:
                frames.pop()
            elif c == ":" and top and top[0] == "{":
                top[3] = True
            elif c == "," and top:
                top[3] = False
                top[2] = "" if top[0] == "{" else top[2] + 1
        return
    for s in found:
        if s["kind"] != "property":
            continue
        key = s["name"] if not s["parent"] or s["parent"]["kind"] != "module" else f"{s['parent']['name']}.{s['name']}"
        for v in re.finditer(r"""(?:([\w.-]+)\s*=\s*)?(["'])""", m.code[s["after"] : s["end"]]):
            at = s["after"] + v.start(2)
            if at in strings:
                if v[1] or not m.code[s["after"] : at].strip():
                    yield at, strings[at], f"{key}.{v[1]}" if v[1] else key


def unquoted(raw: str) -> str:
    """The text of a string literal: escapes decoded where it is valid JSON, else what stands between the quotes."""
    if raw[:1] == '"' and raw[:3] != '"""':
        try:
            return json.loads(raw, strict=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        except ValueError:
            pass
    for q in ('"""', "'''", '"', "'", "`"):
        if len(raw) >= 2 * len(q) and raw.startswith(q) and raw.endswith(q):
            return raw[len(q) : -len(q)]
    return raw.strip("\"'`")


def arguments_of(code: str, opener: int, brackets: Brackets) -> tuple[bool, list[str]]:
    """Whether a call spreads a collection into its arguments, and the names of its named ones, in order."""
    end = brackets.close.get(opener)
    if end is None:
        return False, []
    spreads, names = False, []
    borders = [opener, *brackets.commas.get(opener, ()), end]
    for a, b in zip(borders, borders[1:]):
        text = code[a + 1 : b].strip()
        if text.startswith(("...", "*")) or text.endswith("..."):
            spreads = True
        elif hit := _NAMED_ARGUMENT.match(text):
            names.append(hit[1])
    return spreads, names


def body_span(code: str, start: int, head_end: int, family: str, regions: tuple[list[int], list] = ([], [])) -> tuple[int, int] | None:
    """Where a declaration's body lies: matching braces, deeper indentation, or up to the matching ``end``.

    ``regions``: the starts of comments and strings and these; a line that begins within one is no line of code.
    """
    if code[head_end - 1 : head_end] == ";":
        return None
    if family in ("braces", "sql", "markup"):
        at = head_end - 1 if code[head_end - 1 : head_end] == "{" else head_end
        while at < len(code) and code[at] not in "{;":
            if code[at] == "\n" and code[at - 1 : at] in ",;" and "(" not in code[start:at]:
                return None
            at += 1
        if at >= len(code) or code[at] == ";":
            return None
        depth = 0
        for m in re.compile(r"[{}]").finditer(code, at):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return at, m.end()
        return at, len(code)
    line = code.rfind("\n", 0, start) + 1
    indent = len(code[line:]) - len(code[line:].lstrip(" \t"))
    if family in ("indent", "end"):
        first = code.find("\n", head_end)
        if first < 0:
            return None
        at, end = first + 1, first + 1
        while at < len(code):
            nl = code.find("\n", at)
            stop = len(code) if nl < 0 else nl
            body = code[at:stop]
            i = bisect.bisect_left(regions[0], at) - 1
            if i >= 0 and regions[1][i].end > at:
                end = max(end, len(code[:stop].rstrip())) if body.strip() else end
            elif body.strip():
                if len(body) - len(body.lstrip(" \t")) <= indent:
                    if family == "end" and re.match(r"(?i)\s*end\b", body):
                        end = at + len(body.rstrip())
                    break
                end = at + len(body.rstrip())
            at = stop + 1
        return (first + 1, end) if end > first + 1 else None
    return None


def doc_before(m: Masked, start: int) -> str | None:
    """The run of comments right before a position (blank lines end it), as found."""
    found: list[tuple[int, int]] = []
    at = start
    i = bisect.bisect_left([r.start for r in m.regions], start) - 1
    while i >= 0 and m.regions[i].kind != "string_literal" and not m.text[m.regions[i].end : at].strip() and m.text.count("\n", m.regions[i].end, at) <= 1:
        at = m.regions[i].start
        if m.text[m.text.rfind("\n", 0, at) + 1 : at].strip():
            break
        found.append((at, m.regions[i].end))
        i -= 1
    return m.text[found[-1][0] : found[0][1]] if found else None


def visibility(head: str, name: str, language: str) -> str | None:
    for v in ("private", "protected", "internal", "public"):
        if re.search(rf"\b{v}\b", head):
            return v
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if re.match(r"\s*pub\b", head) else "private"
    if language == "python":
        return "private" if name.startswith("_") else "public"
    if language in P.JS:
        return "public" if re.match(r"\s*export\b", head) else None
    return None


def find_symbols(path: str, language: str, m: Masked, lines: Lines, file_id: str) -> tuple[list[dict], list[dict]]:
    """Declared symbols with parents, bodies and documentation; and imports as pairs of name and span."""
    lang = LANGUAGES[language]
    view = m.bare if lang.family in ("data", "markup") else m.code
    out, imports, seen = [], [], set()
    regions = ([r.start for r in m.regions], m.regions)
    close = partners(m.code)
    for kind, pattern in _compiled(language):
        source = m.bare if kind == "import" else view
        for hit in pattern.finditer(source):
            name = (hit["name"] or "").strip().strip("\"'`<>")
            if not name or (name in KEYWORDS and lang.family != "data") or (hit.start("name"), hit.end("name")) in seen:
                continue
            start = hit.start() + len(hit[0]) - len(hit[0].lstrip())
            if kind == "import":
                imports.append({"name": name, "start": start, "end": hit.end()})
                continue
            seen.add((hit.start("name"), hit.end("name")))
            g = hit.groupdict()
            body = body_span(m.code, start, hit.end(), lang.family, regions) if kind in (*CALLABLE, "class", "struct", "interface", "trait", "enum", "namespace", "module", "union") and lang.family != "data" else None
            if kind == "module" and language == "markdown":
                level = len(hit[0]) - len(hit[0].lstrip(" #"))
                nxt = regex.compile(rf"^ {{0,3}}#{{1,{max(1, min(6, hit[0].strip().count('#', 0, 6)))}}}[ \t]", regex.M).search(m.text, hit.end())
                body = (hit.end(), nxt.start() if nxt else len(m.text))
                del level
            end = max(hit.end(), body[1] if body else 0)
            if body is None and lang.family in ("data", "braces", "indent") and kind in ("constant", "variable", "field", "property", "signature", *CALLABLE):
                if kind not in ("signature", *CALLABLE) or m.code[hit.end() :][:1] == ";" or m.code[hit.end() : hit.end() + 64].lstrip()[:1] == ";":
                    end = max(end, statement_end(m.code, hit.end(), close, language))
            out.append({"after": hit.end(), "kind": kind, "name": name, "at": hit.start("name"), "start": start, "end": end, "body": body, "head": m.text[start : hit.end()].strip().rstrip("{").strip(), "sup": g.get("sup"), "type": g.get("type"), "params": g.get("params")})
    out.sort(key=lambda s: (s["start"], -s["end"]))
    if language == "toml":  # a table lasts until the next one
        for s, nxt in zip(tables := [s for s in out if s["kind"] == "module"], [*(t["start"] for t in tables[1:]), len(m.text)]):
            s["end"] = max(s["end"], nxt)
    if language == "yaml":  # a key holds what is indented below it
        opened: list[tuple[int, dict]] = []
        ends = [(m.start() + len(m[1]), len(m[1]), None) for m in re.finditer(r"^([ \t]*)(?=[^\s#])", m.code, re.M)]
        by_start = {s["start"]: s for s in out}
        for at, indent, _ in [*ends, (len(m.code), -1, None)]:
            top = indent if m.code[at : at + 3] != "---" else -1
            while opened and opened[-1][0] >= top:
                _, s = opened.pop()
                s["end"] = max(s["end"], len(m.code[:at].rstrip()))
            if at in by_start:
                opened.append((indent, by_start[at]))
    stack: list[dict] = []
    for s in out:
        while stack and stack[-1]["end"] <= s["start"]:
            stack.pop()
        s["parent"] = stack[-1] if stack else None
        if s["kind"] == "function" and s["parent"] and s["parent"]["kind"] in ("class", "interface", "trait", "struct"):
            s["kind"] = "method"
        if s["body"] or lang.family == "data":
            stack.append(s)
    # a head without body is a method only where one may be declared; elsewhere it is a call
    out = [s for s in out if s["kind"] != "signature" or (s["parent"] and s["parent"]["kind"] in ("interface", "trait"))]
    for s in out:
        if s["kind"] == "signature":
            s["kind"] = "method"
    # what is declared inside a callable is local, not a symbol
    local = ("field", "property", "variable", "constant")
    out = [s for s in out if not (s["kind"] in local and s["parent"] and s["parent"]["kind"] in CALLABLE)]
    for s in out:
        span = lines.span(s["start"], s["end"])
        s["id"] = hashlib.md5(":".join(map(str, (path, s["name"], *span.values()))).encode()).hexdigest()
    return out, imports


def python_names(text: str, tree: ast.Module) -> dict[tuple[str, int], dict]:
    """What the syntax tree knows of functions and classes: exact ends, docstrings, decorators, returns."""
    out = {}
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out[(n.name, n.lineno)] = {
                "end_line": n.end_lineno, "doc": ast.get_docstring(n, clean=False), "decorators": [ast.unparse(d) for d in n.decorator_list],
                "returns": ast.unparse(n.returns) if getattr(n, "returns", None) else None,
            }
    return out


def _test_role(language: str, s: dict) -> tuple[bool, bool, bool]:
    name, head = s["name"], s["head"]
    case = name.startswith(("test_", "Test")) and s["kind"] in CALLABLE or "@Test" in head or "#[test]" in head or "[Fact]" in head
    container = s["kind"] == "class" and (name.startswith("Test") or name.endswith(("Test", "Tests", "Spec")))
    life = name in ("setUp", "tearDown", "setup_method", "teardown_method", "setUpClass", "tearDownClass")
    return bool(case), bool(container), life


def json_records(text: str) -> Iterator[tuple[str, Lines]]:
    """The records of JSON Lines, one a line that is not blank, with their offsets in the file."""
    base = 0
    for i, chunk in enumerate(text.split("\n")):
        record = chunk.removesuffix("\r")
        if record.strip():
            yield record, Lines(record, i, base)
        base += (len(chunk) if chunk.isascii() else len(chunk.encode("utf-8", "surrogatepass"))) + 1


def sound(fam: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """One file's rows with all foreign keys enforced: they never leave the file."""
    for child, column, parent, key, policy in FOREIGN_KEYS:
        if not fam[child]:
            continue
        known = {r[key] for r in fam[parent]}
        if policy == "drop":
            if any(r[column] not in known for r in fam[child]):
                fam[child] = [r for r in fam[child] if r[column] in known]
        else:
            for r in fam[child]:
                if r.get(column) is not None and r[column] not in known:
                    r[column] = None
    return fam


def extract_file(
    path: str, language: str, text: str, file_id: str | None = None, level: str = "full", policies: dict[str, Policy] | None = None
) -> dict[str, list[dict]]:
    """All row families of one file at a level. Damaged text gives what can be found, and diagnostics.

    JSON Lines files are extracted record by record; places and ids are those in the file.
    """
    file_id = file_id or stable("file", path)
    if language == "json" and re.search(r"\.(?:jsonl|ndjson)$", path, re.I):
        fam: dict[str, list[dict]] = {f: [] for f in FAMILIES}
        for record, lines in json_records(text):
            for f, rows in _extract_text(path, language, record, lines, file_id, level, policies).items():
                fam[f] += rows
        return fam
    if language not in ("html", "vue"):
        return _extract_text(path, language, text, Lines(text), file_id, level, policies)
    guests = embedded.blocks(text)
    host, lines = embedded.without(text, [(a, b) for _, a, b in guests]), Lines(text)
    fam = _extract_text(path, language, host, lines, file_id, level, policies)

    def within(guest: str, a: int, b: int) -> dict[str, list[dict]]:
        at = bisect.bisect_right(lines.starts, a)
        own = Lines(text[a:b], at - 1, lines.byte(a), lines.byte(a) - lines.byte(lines.starts[at - 1]))
        return _extract_text(path, guest, text[a:b], own, file_id, level, policies)

    for guest, a, b in guests:
        embedded.merge(fam, within(guest, a, b))
    if "identifiers" in level_families(level):
        functions: dict[str, list[str]] = {}
        for r in fam["symbols"]:
            if r["kind"] in CALLABLE and r["language"] != language:
                functions.setdefault(r["name"], []).append(r["symbol_id"])
        for a, b, called in embedded.expressions(host, language):
            rows = within("javascript", a, b)
            for r in rows["identifiers"]:
                if called and r["end_byte"] == lines.byte(a + len(text[a:b].rstrip())):
                    r |= {"kind": "call", "metadata_json": None}
                # a name that one function of the file's scripts has is that function's
                to = functions.get(r["name"], [])
                if r["kind"] == "call" and len(to) == 1:
                    r["metadata_json"] = json.dumps(json.loads(r["metadata_json"] or "{}") | {"target_symbol_id": to[0]}, sort_keys=True)
                r["containing_symbol_id"] = r["reference_site_id"] = None
            fam["identifiers"] += rows["identifiers"]
            fam["literals"] += rows["literals"]
    return fam


def _extract_text(path: str, language: str, text: str, lines: Lines, file_id: str, level: str, policies: dict[str, Policy] | None = None) -> dict[str, list[dict]]:
    fam: dict[str, list[dict]] = {f: [] for f in FAMILIES}
    if language not in LANGUAGES:
        return fam
    keep = set(level_families(level))
    m = mask(text, language)
    head = {"file_id": file_id, "path": path, "language": language}
    found, imports = find_symbols(path, language, m, lines, file_id)
    tree_info = {}
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree_info = python_names(text, ast.parse(text))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            at = lines.starts[min(len(lines.starts), getattr(e, "lineno", None) or 1) - 1]
            fam["parse_diagnostics"].append({"diagnostic_id": stable("diagnostic", path, "error", at, str(e)), **head, "kind": "error", "message": str(e)[:500], **lines.span(at, at)})
    elif language == "json":
        try:
            json.loads(text)
        except (ValueError, RecursionError) as e:
            at = min(len(text), getattr(e, "pos", 0))
            fam["parse_diagnostics"].append({"diagnostic_id": stable("diagnostic", path, "error", lines.base + at, str(e)), **head, "kind": "error", "message": str(e)[:500], **lines.span(at, at)})
    elif LANGUAGES[language].family == "braces":
        stack: list[tuple[str, int]] = []

        def fault(kind: str, message: str, at: int, end: int) -> None:
            fam["parse_diagnostics"].append({"diagnostic_id": stable("diagnostic", path, kind, lines.byte(at)), **head, "kind": kind, "message": message, **lines.span(at, end)})

        for b in re.finditer(r"[(){}\[\]]", m.code):
            if b[0] in "({[":
                stack.append((b[0], b.start()))
                if len(stack) > DEPTH:
                    fault("depth_truncated", f"deeper than {DEPTH}", 0, 0)
                    break
                continue
            opener = {")": "(", "]": "[", "}": "{"}[b[0]]
            if not any(o == opener for o, _ in reversed(stack)):
                fault("error", f"unmatched {b[0]}", b.start(), b.end())
                continue
            while stack[-1][0] != opener:  # what was opened inside is not closed
                o, at = stack.pop()
                fault("missing", f"{o} is not closed", at, at + 1)
            stack.pop()
        else:
            for o, at in stack:
                fault("missing", f"{o} is not closed", at, at + 1)

    # the best container of every stretch between two symbol borders: rank, then size, start and id
    borders = sorted({x for s in found for x in (s["start"], s["end"])})
    opening: dict[int, list] = {}
    for s in found:
        opening.setdefault(s["start"], []).append((KIND_RANK.get(s["kind"], 5), s["end"] - s["start"], s["start"], s["id"], s["end"]))
    owners: list[str | None] = []
    active: list[tuple] = []
    for x in borders:
        active = [a for a in active if a[4] > x] + opening.get(x, [])
        owners.append(min(active)[3] if active else None)

    def container(at: int) -> str | None:
        i = bisect.bisect_right(borders, at) - 1
        return owners[i] if i >= 0 else None

    for s in found:
        span = lines.span(s["start"], s["end"])
        info = tree_info.get((s["name"], span["start_line"]), {}) if tree_info else {}
        doc = info.get("doc") or doc_before(m, s["start"])
        body = s["body"]
        test, box, life = _test_role(language, s)
        row = {
            "symbol_id": s["id"], **head, "name": s["name"], "kind": s["kind"], "signature": s["head"], "doc_comment": doc, "visibility": visibility(s["head"], s["name"], language),
            "parent_symbol_id": s["parent"]["id"] if s["parent"] else None, **span, **(lines.span(*body, "body_") if body else {}), "confidence": 1.0 if tree_info else 0.9,
            "body_hash": hashlib.md5("\x1f".join(re.findall(r"\w+|[^\w\s]", m.bare[body[0] : body[1]])).encode()).hexdigest() if body else None,
            "is_test": test, "test_container": box, "test_lifecycle": life,
        }
        fam["symbols"].append(row)
        for d in info.get("decorators", []) or re.findall(r"^[ \t]*(@[\w.]+(?:\([^)\n]*\))?)", m.bare[max(0, m.bare.rfind("\n\n", 0, s["start"])) : s["start"]], re.M):
            name = re.match(r"@?([\w.]+)", d)
            if name and "symbol_annotations" in keep:
                parts = name[1].split(".")
                fam["symbol_annotations"].append({"annotation_id": stable("annotation", s["id"], d), "symbol_id": s["id"], "annotation": name[1], "annotation_key": parts[-1].lower(), "raw_text": d, "carrier": parts[0] if len(parts) > 1 else None})
        t = info.get("returns") or (s["type"] or "").strip()
        if t and "type_facts" in keep:
            fam["type_facts"].append({"type_fact_id": stable("type", s["id"]), "symbol_id": s["id"], "language": language, "resolved_type": t, "is_inferred": not info.get("returns"), "generic_params_json": json.dumps(re.findall(r"[\w.]+", t[t.find("<") + 1 :])) if "<" in t else None})
    callables: dict[str, list[dict]] = {}
    by_name: dict[str, list[dict]] = {}
    for s in found:
        by_name.setdefault(s["name"], []).append(s)
        if s["kind"] in CALLABLE:
            callables.setdefault(s["name"], []).append(s)
    spots = {(s["start"], s["name"]) for s in found}
    ids_of = {s["id"]: s for s in found}

    def enclosing_type(s: dict | None) -> dict | None:
        while s and s["kind"] not in ("class", "struct", "interface", "trait", "enum", "union"):
            s = s["parent"]
        return s

    declared = {s["at"] for s in found}

    def site(start: int, end: int, provenance: str) -> str:
        sid = stable("site", file_id, lines.byte(start), lines.byte(end))
        fam["reference_sites"].append({"reference_site_id": sid, **head, "containing_symbol_id": container(start), **lines.span(start, end), "is_exact": True, "provenance": provenance})
        return sid

    def pending(from_id: str, kind: str, target: str, receiver: str | None, start: int, end: int, context: str | None = None, arity: int | None = None, of: str | None = None) -> None:
        told = {k: v for k, v in (("receiver_type", of), ("arity", arity)) if v is not None}
        parts = [p for p in re.split(r"\.|::|->|/|\\", target) if p]
        fam["pending_relationships"].append({
            "pending_relationship_id": stable("pending", from_id, kind, target, lines.byte(start)), "reference_site_id": site(start, end, "token"), "from_symbol_id": from_id, "caller_scope_symbol_id": from_id,
            "file_id": file_id, "path": path, "kind": kind, "target_display_name": target, "target_terminal_name": parts[-1] if parts else target, "target_receiver": receiver,
            "target_namespace_json": json.dumps(parts[:-1]), "target_import_context": context, **lines.span(start, end), "confidence": 0.7, "metadata_json": json.dumps(told, sort_keys=True) if told else None,
        })

    brackets = Brackets(m.code, language) if {"literals", "relationships", "source_regions"} & keep else None
    if "relationships" in keep and LANGUAGES[language].family not in ("data",):
        for s in found:
            for base in re.findall(r"[\p{L}_$][\w$.:\\]*".replace(r"\p{L}", "A-Za-z"), re.sub(r"<[^<>]*>", "", s["sup"] or "")):
                target = [x for x in by_name.get(base.split(".")[-1], []) if x["kind"] in ("class", "interface", "trait", "struct")]
                at = m.code.find(base, s["start"], s["end"])
                at = at if at >= 0 else s["start"]
                if len(target) == 1:
                    fam["relationships"].append({"relationship_id": stable("rel", s["id"], target[0]["id"], "extends"), "reference_site_id": site(at, at + len(base), "token"), "from_symbol_id": s["id"], "to_symbol_id": target[0]["id"], "file_id": file_id, "path": path, "kind": "extends", **lines.span(at, at + len(base)), "confidence": 1.0})
                else:
                    pending(s["id"], "extends", base, None, at, at + len(base))
        if found:
            for i in imports:
                pending(found[0]["id"], "imports", i["name"], None, i["start"], i["end"], "relative" if i["name"].startswith((".", "/")) else "external")
    if "relationships" in keep and language == "sql":
        tables = {bare(s["name"]): s for s in reversed(found) if s["kind"] in ("class", "table", "struct")}
        for kind, source, target, a, b in table_edges(m.bare):
            frm, to = tables.get(source), tables.get(target)
            if frm and to:
                fam["relationships"].append({"relationship_id": stable("rel", frm["id"], to["id"], kind, lines.byte(a)), "reference_site_id": site(a, b, "token"), "from_symbol_id": frm["id"], "to_symbol_id": to["id"], "file_id": file_id, "path": path, "kind": kind, **lines.span(a, b), "confidence": 0.9})
            elif frm and kind == "references":
                pending(frm["id"], kind, target, None, a, b)
    if "relationships" in keep and language == "yaml":
        anchors: dict[str, tuple[dict, int]] = {}
        for t in re.finditer(r"^---[^\n]*$|(?<![\w&*])&([\w-]+)|(?<![\w&*])\*([\w-]+)", m.code, re.M):
            owner = next((s for s in found if s["id"] == container(t.start())), None)
            if t[0].startswith("---"):
                anchors = {}
            elif t[1] and owner:
                anchors[t[1]] = (owner, t.start())
            elif t[2] and owner and t[2] in anchors:
                to = anchors[t[2]][0]
                fam["relationships"].append({"relationship_id": stable("rel", owner["id"], to["id"], "references", lines.byte(t.start())), "reference_site_id": site(t.start(), t.end(), "token"), "from_symbol_id": owner["id"], "to_symbol_id": to["id"], "file_id": file_id, "path": path, "kind": "references", **lines.span(t.start(), t.end()), "confidence": 1.0})
    if "relationships" in keep and LANGUAGES[language].family not in ("data", "markup"):
        code = m.code
        nested: set[int] = set()

        def before(at: int) -> str:
            """What stands before a position, as far as the longest word that names a type after it, without blanks."""
            end = _NOT_SPACE.search(code, 0, at)
            return code[max(0, end.end() - 12) : end.end()] + code[end.end() : at][:1] if end else ""

        for w in _WORD.finditer(code):
            name, a, b = w[0], w.start(), w.end()
            if name in KEYWORDS or (a, name) in spots:
                continue
            after = code[b : b + 1]
            dotted = code[a - 1 : a] == "." or code[a - 2 : a] in ("::", "->")
            kind = "call" if after == "(" or (after == "!" and code[b + 1 : b + 2] == "(") else "member_access" if dotted else "type_usage" if name[:1].isupper() and _NAMED_TYPE.search(before(a)) else "variable_ref"
            if kind in ("variable_ref", "member_access") and name[:1].isupper() and a not in declared and (brackets.typed(b) or (language != "python" and brackets.square(b, m.bare))):
                kind = "type_usage"
            inside = container(a)
            receiver = None
            if dotted:
                r = _RECEIVER.match(code, 0, a)
                receiver = r[1] if r else None
            meta = {}
            if kind in ("variable_ref", "member_access"):
                eq = _ASSIGN.match(code, b)
                meta["access"] = "read" if not eq else "write" if eq[1] in ("=", ":=") else "read_write"
            if receiver:
                meta["receiver"] = receiver
            if kind == "call":
                args = brackets.items(b + 1 if after == "!" else b)
                if args is not None:  # a call that is not closed has none
                    meta["arg_count"] = args
                    opener = b + 1 if after == "!" else b
                    spread_, names = arguments_of(code, opener, brackets)
                    if spread_:
                        meta["arg_spread"] = True
                    if names:
                        meta["arg_names"] = names
                if name in TEST_CALLS:
                    meta["test_role"] = TEST_CALLS[name]
            if "identifiers" in keep:
                own_id = stable("identifier", file_id, lines.byte(a), name)
                fam["identifiers"].append({"identifier_id": own_id, "reference_site_id": stable("site", file_id, lines.byte(a), lines.byte(b)) if kind == "call" else None, **head, "name": name, "kind": kind, "containing_symbol_id": inside, **lines.span(a, b), "confidence": 0.9, "metadata_json": (json.dumps(meta, sort_keys=True) if "arg_names" in meta else _told(*meta.items())) if meta else None})
                opener = b + 2 if after == ":" else b
                if kind == "type_usage" and a not in declared and opener in brackets.close and (code[opener] == "<" or brackets.square(opener, m.bare)) and opener not in nested:
                    arguments, within = type_arguments(brackets, m.bare, opener)
                    nested |= within
                    if arguments:
                        uid, ids = stable("usage", file_id, lines.byte(a)), {}
                        fam["type_argument_usages"].append({"usage_id": uid, "identifier_id": own_id, **head})
                        for up, at, n, arg in arguments:
                            ids[at] = stable("argument", uid, ids.get(up), at, arg)
                            fam["type_arguments"].append({"type_argument_id": ids[at], "usage_id": uid, "parent_type_argument_id": ids.get(up), "ordinal": n, "type_name": arg})
            if kind == "call" and inside:
                to = callables.get(name, [])
                # a call on the own object means the own type's callable, whatever else bears the name
                own = enclosing_type(ids_of[inside]) if receiver in ("self", "this", "Self") else None
                if own:
                    to = [t for t in to if t["parent"] is own]
                if len(to) == 1 and to[0]["id"] != inside:
                    fam["relationships"].append({"relationship_id": stable("rel", inside, to[0]["id"], "calls", lines.byte(a)), "reference_site_id": site(a, b, "token"), "from_symbol_id": inside, "to_symbol_id": to[0]["id"], "file_id": file_id, "path": path, "kind": "calls", **lines.span(a, b), "confidence": 0.9})
                elif not to:
                    pending(inside, "calls", name if not receiver else f"{receiver}.{name}", receiver, a, b, arity=meta.get("arg_count"), of=own["name"] if own else None)
    if "literals" in keep or "source_regions" in keep:
        carriers: dict[int, str] = {}
        rules, config = (policies or POLICIES).get(language), language in ("json", "toml", "yaml")

        def literal(a: int, b: int, content: str, carrier: str | None, position: int) -> None:
            kind = classify(rules, carrier)
            if kind and content:
                fam["literals"].append({"literal_id": stable("literal", file_id, lines.byte(a)), **head, "literal_text": content, "kind": kind, "carrier": carrier, "arg_position": position, "containing_symbol_id": container(a), **lines.span(a, b), "confidence": 1.0 if config else 0.9})

        for r in m.regions:
            inside = container(r.start)
            fam["source_regions"].append({"source_region_id": stable("region", file_id, r.kind, lines.byte(r.start)), **head, "kind": r.kind, "containing_symbol_id": inside, **lines.span(r.start, r.end)})
            if r.kind != "string_literal" or config or language == "markdown":
                continue
            opener = brackets.enclosing(r.start)
            if opener not in carriers:
                run = _CARRIER.match(m.code, 0, opener) if opener > 0 and m.code[opener] == "(" else None
                start = _STARTER.search(run[0]) if run else None
                carriers[opener] = run[0][start.start() :] if start else ""
            carrier, position = carriers[opener], brackets.position(opener, r.start)
            if carrier or rules and rules.keep_all:
                literal(r.start, r.end, re.sub(r"\$\{[^}]*\}|#\{[^}]*\}|\{[^{}]*\}", "{}", unquoted(text[r.start : r.end])), re.sub("::|->", ".", carrier) or None, position)
        if config:
            for a, b, path_ in config_values(m, language, found):
                literal(a, b, unquoted(text[a:b]), path_, 0)
        elif language == "markdown":
            for link in re.finditer(r"\]\(\s*<?([^)\s>]+)", m.bare):
                literal(link.start(1), link.end(1), link[1], None, 0)
    if "structural_facts" in keep:
        views = {"raw": m.text, "code": m.code, "bare": m.bare}

        def fact(pattern: str, node: str, a: int, b: int, meta: dict) -> None:
            fam["structural_facts"].append({"structural_fact_id": stable("fact", file_id, pattern, lines.byte(a), lines.byte(b)), **head, "pattern_id": pattern, "capture_name": pattern.split(".")[-2], "node_kind": node, "containing_symbol_id": container(a), **lines.span(a, b), "confidence": 1.0, "metadata_json": _FACT(meta) if meta else None})

        for p, expression in P.for_language(language):
            for hit in expression.finditer(views[p.on]):
                meta = {k: v for k, v in hit.groupdict().items() if v is not None and k != "q"}
                fact(p.id, p.node, hit.start(), hit.end(), meta)
        for a, b, meta in markers(m):
            fact("code.marker.v1", "comment", a, b, meta)
        for pid, langs, expression in P.FILE_ROUTES:
            if language in langs and (hit := re.match(expression, path)):
                route = next((v for v in hit.groups() if v is not None), "")
                fact(pid, "program", 0, len(text), {"route": "/" + re.sub(r"(^|/)index$", "", re.sub(r"\[+(?:\.\.\.)?(\w+)\]+", r":\1", route))})
        fam["structural_facts"].sort(key=lambda f: (f["start_byte"], f["end_byte"], f["pattern_id"], f["structural_fact_id"]))
    if "complexity_metrics" in keep:

        def metric(scope: str, symbol: dict | None, a: int, b: int) -> None:
            code = m.code[a:b]
            depth = most = 0
            for c in re.finditer(r"[{}]", code):
                depth += 1 if c[0] == "{" else -1
                most = max(most, depth)
            if LANGUAGES[language].family == "indent":
                levels = [len(x) - len(x.lstrip(" ")) for x in code.split("\n") if x.strip()]
                most = len(set(levels)) - 1 if levels else 0
            span = lines.span(a, b)
            params = symbol and symbol["params"]
            inner = params[1:-1].strip() if params and params[:1] == "(" else (params or "").strip()
            fam["complexity_metrics"].append({
                "complexity_metric_id": stable("complexity", file_id, scope, symbol["id"] if symbol else lines.base or ""), **head, "scope": scope, "symbol_id": symbol["id"] if symbol else None, "algorithm_id": "tokens.v1",
                "covered_lines": span["end_line"] - span["start_line"] + 1, "covered_bytes": span["end_byte"] - span["start_byte"], "decision_count": len(re.findall(DECISIONS, code)), "loop_count": len(re.findall(LOOPS, code)),
                "max_nesting_depth": min(most, DEPTH), "parameter_count": (len(_PARAMS.split(inner)) if inner else 0) if symbol else None, **span,
            })

        metric("file", None, 0, len(text))
        for s in found:
            if s["kind"] in CALLABLE:
                metric("symbol", s, *(s["body"] or (s["start"], s["end"])))
    for f in FAMILIES:
        if f not in keep:
            fam[f] = []
        else:  # first write wins
            first: dict[str, dict] = {}
            key = TABLES[f].names[0]
            for r in fam[f]:
                first.setdefault(r[key], r)
            fam[f] = list(first.values())
    return fam


RESULT = T.StructType([T.StructField("file_id", T.StringType()), *(T.StructField(f, T.ArrayType(T.StructType([T.StructField(x.name, x.dataType) for x in TABLES[f]]))) for f in FAMILIES)])


def rows_of(r: dict, level: str, policies: dict[str, Policy] | None = None) -> dict[str, list[dict]]:
    """One snapshot's rows with its foreign keys enforced; none without text, one diagnostic where the extraction fails."""
    if r["text"] is None:
        return {}
    try:
        return sound(extract_file(r["path"] or "", r["language"], r["text"], r["file_id"], level, policies))
    except Exception as e:  # noqa: BLE001 - one file must not fail the others
        zero = dict.fromkeys(("start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte"), 0)
        return {"parse_diagnostics": [{"diagnostic_id": stable("diagnostic", r["path"], "failed"), "file_id": r["file_id"], "path": r["path"], "language": r["language"], "kind": "failed", "message": f"{type(e).__name__}: {e}"[:500], **zero}]}


def extract(snapshots: DataFrame, level: str = "full", text: str = "text", policies: dict[str, Policy] | None = None) -> DataFrame:
    """One row a file: ``file_id`` and an array for each row family.

    ``snapshots`` has file_id, path, language and the text column; rows without file_id, text or known language give empty
    arrays. A file whose extraction fails gives one diagnostic (kind ``failed``) instead of failing the job. Foreign
    keys are enforced within the file.
    """
    known = spread(snapshots.where("file_id is not null").select("file_id", "path", "language", F.col(text).alias("text")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RESULT)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = []
                for r in b.slice(at, 64).to_pylist():
                    fam = rows_of(r, level, policies)
                    rows.append({"file_id": r["file_id"], **{f: fam.get(f, []) for f in FAMILIES}})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return known.mapInArrow(run, RESULT)


#: Of the families without language, the required key to a row that has one.
_OWNERS = {child: (column, parent, key) for child, column, parent, key, policy in reversed(FOREIGN_KEYS) if policy == "drop" and "language" not in TABLES[child].names}


def counts(snapshots: DataFrame, level: str = "full", text: str = "text", policies: dict[str, Policy] | None = None) -> DataFrame:
    """``family, language, rows`` of what ``extract`` gives, counted where the files are read: no row of a family leaves its task.

    Languages are those of the rows, or of the rows they belong to where a family has none. Foreign keys are enforced within the file, which is all their reach.
    """
    known = spread(snapshots.where("file_id is not null").select("file_id", "path", "language", F.col(text).alias("text")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n: Counter = Counter()
            for at in range(0, b.num_rows, 64):
                for r in b.slice(at, 64).to_pylist():
                    fam = rows_of(r, level, policies)
                    for f, rows in fam.items():
                        if f not in _OWNERS:
                            n.update((f, x["language"]) for x in rows)
                        elif rows:
                            column, parent, key = _OWNERS[f]
                            of = {x[key]: x["language"] for x in fam[parent]}
                            n.update((f, of[x[column]]) for x in rows)
            yield pa.RecordBatch.from_pylist([{"family": f, "language": l, "rows": k} for (f, l), k in n.items()], schema=pa.schema([("family", pa.string()), ("language", pa.string()), ("rows", pa.int64())]))

    return known.mapInArrow(run, "family string, language string, rows long").groupBy("family", "language").agg(F.sum("rows").alias("rows"))


def family(extracted: DataFrame, name: str, owner: str | None = None) -> DataFrame:
    """The table of one row family; ``owner`` names a column for the file that each row comes from."""
    head = [F.col("file_id").alias(owner)] if owner else []
    return extracted.select(*head, F.explode(name).alias("r")).select(*([owner] if owner else []), "r.*")
