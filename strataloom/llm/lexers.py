"""Tokens of the supported languages: kinds for the recogniser, and where a statement may end without a mark.

Each lexer gives ``(kinds, may_end)``; a keyword's or operator's kind is its text, names are ID, literals by class.
What is no token gives the kind ERR, which no grammar accepts.
"""

from __future__ import annotations

import re

Tokens = tuple[list[str], list[bool] | None]


def _ops(text: str) -> str:
    return "|".join(re.escape(o) for o in sorted(text.split(), key=len, reverse=True))


# ---------------------------------------------------------------- JSON

_JSON = re.compile(
    r'[ \t\n\r]+|(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(?P<NUM>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<W>true|false|null)|(?P<OP>[{}\[\]:,])|(?P<ERR>.)",
    re.S,
)


def json_tokens(text: str) -> Tokens:
    out = []
    for m in _JSON.finditer(text):
        k = m.lastgroup
        if k:
            out.append(m[0] if k in ("W", "OP") else k)
            if k == "ERR":
                break
    return out, None


# ---------------------------------------------------------------- TOML 1.0

_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_CLOCK = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
_TOML_STR = (
    r'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|"{1,2}(?!"))*+"{3,5}'
    r"|'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'{1,2}(?!'))*+'{3,5}"
)
_TOML_ONE = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+"|' r"'[^'\x00-\x08\x0a-\x1f\x7f]*+'"
_TOML_SKIP = r"[ \t]+|#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*+(?=\n|\Z)|(?P<NL>\r?\n)"
_TOML_KEY = re.compile(_TOML_SKIP + rf"|(?P<ML>\"\"\"|''')|(?P<STR>{_TOML_ONE})|(?P<KEY>[A-Za-z0-9_-]+)|(?P<OP>\[\[|\]\]|[=.\[\]{{}},])|(?P<ERR>.)", re.S)
_TOML_VALUE = re.compile(
    _TOML_SKIP
    + rf"|(?P<STR>{_TOML_STR}|{_TOML_ONE})"
    + rf"|(?P<VAL>(?:{_DATE}(?:[Tt ]{_CLOCK}(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|{_CLOCK}|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*"
    + r"|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)|\.\d(?:_?\d)*)?|true|false)(?![\w.+-]))"
    + r"|(?P<OP>[\[\]{},])|(?P<ERR>.)",
    re.S,
)


def toml_tokens(text: str) -> Tokens:
    """Keys and values are told apart by where they stand: after ``=`` and inside arrays comes a value."""
    out: list[str] = []
    at, n = 0, len(text)
    stack: list[str] = []  # open brackets of values
    value = False
    head = True  # nothing but white space on this line so far
    while at < n:
        m = (_TOML_VALUE if value or (stack and stack[-1] == "[") else _TOML_KEY).match(text, at)
        k = m.lastgroup
        at = m.end()
        if k is None:
            continue
        if k == "NL":
            if not (stack and stack[-1] == "["):
                out.append("NL")
                value = False
                head = True
            continue
        t = m[0]
        if k == "OP":
            if t == "=" and not value:
                value = True
            elif value or stack:
                if t in "[{" and (value or stack[-1] == "["):
                    stack.append(t)
                    value = t == "["
                elif t in "]}" and stack:
                    if stack.pop() != {"]": "[", "}": "{"}[t]:
                        return ["ERR"], None
                    value = bool(stack) and stack[-1] == "["
                elif t == ",":
                    value = bool(stack) and stack[-1] == "["
            elif t == "]]" and "[[" not in out[-64:]:
                out += ["]", "]"]
                continue
            elif t == "[[" and not head:
                out += ["[", "["]
                continue
            out.append(t)
        else:
            if k in ("ERR", "ML"):
                return ["ERR"], None
            if k in ("STR", "VAL") and (value or (stack and stack[-1] == "[")):
                out.append("VAL")
                value = bool(stack) and stack[-1] == "["
            else:
                out.append("KEY")
        head = False
    out.append("NL")
    return out, None


# ---------------------------------------------------------------- Python 3

PYTHON_KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield match case type _".split()
)
_PY_OP = _ops("+ - * / // % ** @ & | ^ ~ < > <= >= == != << >> -> := = += -= *= /= //= %= **= @= &= |= ^= <<= >>= . ... , : ; ( ) [ ] { }")
_PY_PRE = r"(?:[bB][rR]?|[rR][bB]?|[uU])?"
_PY_LONG = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|' r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
_PY_SHORT = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*+"|' r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*+'"
_PY_HOLE = r"\{(?:[^{}\"'\n]|\"[^\"\n]*+\"|'[^'\n]*+'|\{[^{}]*+\})+\}"
_PY_F = (
    rf'"""(?:[^"\\{{}}]|\\[\s\S]|"(?!"")|\{{\{{|\}}\}}|\{{(?:[^{{}}]|\{{[^{{}}]*+\}})+\}})*+"""'
    rf"|'''(?:[^'\\{{}}]|\\[\s\S]|'(?!'')|\{{\{{|\}}\}}|\{{(?:[^{{}}]|\{{[^{{}}]*+\}})+\}})*+'''"
    rf'|"(?:[^"\\{{}}\n]|\\(?:\r\n|[\s\S])|\{{\{{|\}}\}}|{_PY_HOLE})*+"'
    rf"|'(?:[^'\\{{}}\n]|\\(?:\r\n|[\s\S])|\{{\{{|\}}\}}|{_PY_HOLE})*+'"
)
_PY = re.compile(
    r"[ \t\f]+|\\\r?\n|(?P<COM>#[^\n]*+)|(?P<NL>\r\n|\n|\r)"
    rf"|(?P<FSTR>(?:[fF][rR]?|[rR][fF])(?:{_PY_F}))|(?P<BADF>(?:[fF][rR]?|[rR][fF])[\"'])"
    rf"|(?P<STR>{_PY_PRE}(?:{_PY_LONG}|{_PY_SHORT}))"
    r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![\w]))"
    rf"|(?P<ID>[^\W\d]\w*)|(?P<OP>{_PY_OP}|!=)|(?P<ERR>[\s\S])"
)
_PY_ZERO = re.compile(r"0[_0]*[1-9][\d_]*$")


def python_tokens(text: str) -> Tokens:
    if "\0" in text:
        return ["ERR"], None
    if text.startswith("﻿"):
        text = text[1:]
    out: list[str] = []
    indents = [(0, 0)]
    depth: list[str] = []
    at, n, fresh = 0, len(text), True
    scan = _PY.match
    while at < n:
        if fresh and not depth:
            # the indentation of a line that holds something
            col = alt = 0
            while at < n and text[at] in " \t\f":
                c = text[at]
                col, alt = (col + 1, alt + 1) if c == " " else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
                at += 1
            if at >= n:
                break
            if text[at] not in "#\r\n" and not (text[at] == "\\" and text[at + 1 : at + 2] in ("\n", "\r")):
                last = indents[-1]
                if col == last[0]:
                    if alt != last[1]:
                        return ["ERR"], None
                elif col > last[0]:
                    if alt <= last[1]:
                        return ["ERR"], None
                    indents.append((col, alt))
                    out.append("INDENT")
                else:
                    while indents[-1][0] > col:
                        indents.pop()
                        out.append("DEDENT")
                    if indents[-1] != (col, alt):
                        return ["ERR"], None
            fresh = False
        m = scan(text, at)
        k = m.lastgroup
        at = m.end()
        if k is None or k == "COM":
            continue
        if k == "NL":
            if not depth:
                if out and out[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                    out.append("NEWLINE")
                fresh = True
            continue
        t = m[0]
        if k == "ID":
            out.append(t if t in PYTHON_KEYWORDS else "ID")
        elif k == "OP":
            if t in "([{":
                depth.append(t)
            elif t in ")]}":
                if not depth or depth.pop() + t not in ("()", "[]", "{}"):
                    return ["ERR"], None
            out.append(t)
        elif k in ("ERR", "BADF") or (k == "NUM" and _PY_ZERO.match(t)):
            return ["ERR"], None
        else:
            out.append("STR" if k == "FSTR" else k)
    if depth:
        return ["ERR"], None
    if out and out[-1] not in ("NEWLINE", "DEDENT"):
        out.append("NEWLINE")
    out += ["DEDENT"] * (len(indents) - 1)
    return out, None


# ---------------------------------------------------------------- Java 17

JAVA_KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for "
    "goto if implements import instanceof int interface long native new package private protected public return short static strictfp "
    "super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
JAVA_SOFT = frozenset("record sealed permits yield var module open opens exports requires uses provides to with transitive".split())
_DIGITS = r"\d(?:_*\d)*"
_JAVA = re.compile(
    r"\s+|//[^\n\r]*+|/\*[\s\S]*?\*/|(?P<BADC>/\*)"
    r'|(?P<TEXT>"""[ \t\f]*(?:\r\n|\n|\r)(?:[^"\\]|\\[\s\S]|"(?!""))*+""")|(?P<BADT>""")'
    r'|(?P<STR>"(?:[^"\\\n\r]|\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*+")'
    r"|(?P<CHAR>'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    rf"|(?P<NUM>(?:0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?\.?(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?[pP][+-]?{_DIGITS}[fFdD]?|0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?"
    rf"|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[fFdDlL]?)(?![\w$]))"
    r"|(?P<NS>non-sealed\b)|(?P<ID>(?:[^\W\d]|\$)[\w$]*)"
    rf"|(?P<OP>{_ops('( ) { } [ ] ; , . ... @ :: = < ! ~ ? : -> == <= != && || ++ -- + - * / & | ^ % << += -= *= /= &= |= ^= %= <<= >')})|(?P<ERR>[\s\S])"
)


def _gt(text: str, end: int) -> str:
    """``>`` alone, or right before another ``>`` or ``=``: operators are put together by the grammar."""
    return ">~" if text[end : end + 1] in (">", "=") and text[end : end + 1] else ">"


def java_tokens(text: str) -> Tokens:
    out: list[str] = []
    text = text.removesuffix("\x1a")
    for m in _JAVA.finditer(text):
        k = m.lastgroup
        if k is None:
            continue
        t = m[0]
        if k == "ID":
            out.append(t if t in JAVA_KEYWORDS or t in JAVA_SOFT else "ID")
        elif k == "OP":
            out.append(_gt(text, m.end()) if t == ">" else t)
        elif k in ("ERR", "BADC", "BADT"):
            return ["ERR"], None
        else:
            out.append("STR" if k == "TEXT" else k)
    return out, None


# ---------------------------------------------------------------- Go

GO_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select "
    "struct switch type var".split()
)
_GO_ENDS = frozenset("ID NUM STR CHAR break continue fallthrough return ++ -- ) ] }".split())
_GO_ESC = r"\\(?:[abfnrtv\\]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_GO = re.compile(
    r"[ \t\r]+|(?P<NL>\n)|//[^\n]*+|(?P<COM>/\*[\s\S]*?\*/)|(?P<BADC>/\*)"
    rf'|(?P<STR>`[^`]*+`|"(?:[^"\\\n]|{_GO_ESC}|\\")*+")'
    rf"|(?P<CHAR>'(?:[^'\\\n]|{_GO_ESC}|\\')')"
    r"|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])*\.?(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?[pP][+-]?\d(?:_?\d)*i?|0[xX](?:_?[0-9a-fA-F])+i?|0[oO](?:_?[0-7])+i?|0[bB](?:_?[01])+i?"
    r"|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?i?)(?![\w]))"
    rf"|(?P<ID>[^\W\d]\w*)|(?P<OP>{_ops('+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... ( [ { , . ) ] } ; :')})|(?P<ERR>[\s\S])"
)


def go_tokens(text: str) -> Tokens:
    out: list[str] = []
    if text.startswith("﻿"):
        text = text[1:]
    for m in _GO.finditer(text):
        k = m.lastgroup
        if k is None:
            continue
        if k == "NL" or (k == "COM" and "\n" in m[0]):
            if out and out[-1] in _GO_ENDS:
                out.append(";")
        elif k == "ID":
            t = m[0]
            out.append(t if t in GO_KEYWORDS else "ID")
        elif k == "OP":
            out.append(m[0])
        elif k in ("ERR", "BADC"):
            return ["ERR"], None
        elif k != "COM":
            out.append(k)
    if out and out[-1] in _GO_ENDS:
        out.append(";")
    return out, None


# ---------------------------------------------------------------- Rust 2021

RUST_KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return "
    "self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv try typeof "
    "unsized virtual yield union auto default macro_rules raw safe _".split()
)
_RUST_ESC = r"\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\})"
_RUST = re.compile(
    r"\s+|(?P<DOC>///(?!/)[^\n]*+)|(?P<IDOC>//![^\n]*+)|//[^\n]*+|(?P<COM>/\*)"
    r'|(?P<RAW>(?:b|c)?r(?P<H>\#*)"[\s\S]*?"(?P=H))'
    rf'|(?P<STR>[bc]?"(?:[^"\\]|{_RUST_ESC}|\\\r?\n)*+")'
    rf"|(?P<CHAR>b?'(?:[^'\\\n\r\t]|{_RUST_ESC})')|(?P<LIFE>'(?:r\#)?[^\W\d]\w*(?!'))"
    r"|(?P<NUM>0x[0-9a-fA-F_]*[0-9a-fA-F][0-9a-fA-F_]*(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?(?!\w)"
    r"|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]*\d[\d_]*)?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)))"
    r"|(?P<ID>(?:r\#)?[^\W\d]\w*)"
    rf"|(?P<OP>{_ops('+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= = == != <= < @ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { } >')})|(?P<ERR>[\s\S])"
)
_RUST_NEST = re.compile(r"/\*|\*/")


def rust_tokens(text: str) -> Tokens:
    out: list[str] = []
    at, n = 0, len(text)
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        at = text.find("\n") % (n + 1)
    scan = _RUST.match
    while at < n:
        m = scan(text, at)
        k = m.lastgroup
        at = m.end()
        if k is None:
            continue
        if k == "COM":
            depth = 1
            doc = "IDOC" if text.startswith("!", at) else "DOC" if text.startswith("*", at) and text[at + 1 : at + 2] not in ("*", "/") else None
            while depth:
                c = _RUST_NEST.search(text, at)
                if not c:
                    return ["ERR"], None
                depth += 1 if c[0] == "/*" else -1
                at = c.end()
            if doc:
                out.append(doc)
        elif k == "ID":
            t = m[0]
            out.append(t if t in RUST_KEYWORDS else "ID")
        elif k == "OP":
            t = m[0]
            out.append(_gt(text, at) if t == ">" else t)
        elif k == "ERR":
            return ["ERR"], None
        else:
            out.append("STR" if k in ("RAW", "H") else k)
    return out, None


# ---------------------------------------------------------------- ECMAScript 2022 modules, TypeScript 5

SCRIPT_KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with yield let static await "
    "implements interface package private protected public".split()
)
SCRIPT_SOFT = frozenset("as async from get of set meta target accessor".split())
TYPE_SOFT = frozenset(
    "abstract asserts constructor declare global infer is keyof module namespace never out override readonly require satisfies type unique".split()
)
_SCRIPT = re.compile(
    r"(?P<WS>[\s﻿]+)|(?P<LC>//[^\n\r\u2028\u2029]*+)|(?P<MC>/\*[\s\S]*?\*/)|(?P<BADC>/\*)"
    r"|(?P<STR>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+')"
    r"|(?P<NUM>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?"
    r"|(?:(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?))(?![\w$]))"
    r"|(?P<ID>(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)|(?P<PRIV>\#(?:[^\W\d]|[$])[\w$]*)"
    rf"|(?P<OP>{_ops('{ ( ) [ ] . ... ; , < <= == != === !== + - * % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= %= **= <<= &= |= ^= &&= ||= ??= => @ >')})"
    r"|(?P<TICK>`)|(?P<SLASH>/)|(?P<CLOSE>\})|(?P<ERR>[\s\S])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[a-zA-Z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
_BEFORE_DIVISION = frozenset("ID NUM STR REGEX TEMPLATE TTAIL PRIV ) ] } this super null true false ++ --".split()) | SCRIPT_SOFT | TYPE_SOFT


def _script(text: str, soft: frozenset[str]) -> Tokens:
    out: list[str] = []
    flags: list[bool] = []
    at, n = 0, len(text)
    if text.startswith("﻿"):
        at = 1
    if text.startswith("#!", at):
        at = text.find("\n") % (n + 1)
    line = False
    braces: list[str] = []  # what each open brace belongs to
    scan = _SCRIPT.match
    while at < n:
        m = scan(text, at)
        k = m.lastgroup
        at = m.end()
        t = m[0]
        if k == "WS" or k == "MC":
            line = line or "\n" in t or "\r" in t or "\u2028" in t
            continue
        if k == "LC":
            continue
        if k == "ID":
            kind = t if t in SCRIPT_KEYWORDS or t in soft else "ID"
        elif k == "OP":
            kind = _gt(text, at) if t == ">" else t
            if t == "{":
                braces.append("{")
            elif t == "?." and at < n and text[at].isdigit():
                at -= 1
                kind = "?"
        elif k == "CLOSE":
            if braces and braces.pop() == "`":
                m = _TEMPLATE.match(text, at)
                if not m:
                    return ["ERR"], None
                at = m.end()
                kind = "TTAIL" if m[1] == "`" else "TMID"
                if kind == "TMID":
                    braces.append("`")
            else:
                kind = "}"
        elif k == "TICK":
            m = _TEMPLATE.match(text, at)
            if not m:
                return ["ERR"], None
            at = m.end()
            kind = "TEMPLATE" if m[1] == "`" else "THEAD"
            if kind == "THEAD":
                braces.append("`")
        elif k == "SLASH":
            if out and out[-1] in _BEFORE_DIVISION:
                kind = "/"
                if text.startswith("=", at):
                    kind, at = "/=", at + 1
            else:
                m = _REGEX.match(text, at - 1)
                if not m:
                    return ["ERR"], None
                at = m.end()
                kind = "REGEX"
        elif k in ("ERR", "BADC"):
            return ["ERR"], None
        else:
            kind = k
        out.append(kind)
        flags.append(line or kind == "}")
        line = False
    flags.append(True)
    return out, flags


def javascript_tokens(text: str) -> Tokens:
    return _script(text, SCRIPT_SOFT)


def typescript_tokens(text: str) -> Tokens:
    return _script(text, SCRIPT_SOFT | TYPE_SOFT)
