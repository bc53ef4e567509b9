"""Functions paired with their documentation: code-description pairs without empty or trivial documentation.

Functions are found in the file's bytes by one recursive pattern per family of languages (comment, signature and
balanced body together, strings and comments protected); the recorded spans say which of the found functions a symbol
is, and cut the code only where a damaged file does not balance. The documentation is judged line by line and sentence by sentence: ``says_something`` holds when one
of them is left after marks, placeholders, pointers, directives, notices, bare tags, code and the function's own
name are taken away.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- documentation

_OPEN = regex.compile(r"^\s*(?:(?:[rRuUbBfF]{0,2}(?:\"\"\"|'''))|/\*[*!]*|<!--|//[/!]*|--+(?=\s|$)|[#*;%]+(?!\w)|#+!?|;+)")
_CLOSE = regex.compile(r"(?:\*+/|\"\"\"|'''|-->)\s*$")
_TAG_MARKUP = regex.compile(r"</?[A-Za-z][\w.:-]*(?:\s[^<>]*)?/?>")
_DECOR = regex.compile(r"[^\p{L}\p{N}]+")
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_WORD = regex.compile(r"\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{Lu}+(?!\p{Ll})|\p{Lu}|\p{N}+")

_FILLER = frozenset(
    "a an the this that these it its function method procedure routine subroutine helper func fn to of for is are be does do "
    "did used will which implementation simply just and new".split()
)
_TYPES = frozenset(
    "int integer long short byte char float double number numeric decimal bool boolean str string bytes text list array vec vector "
    "dict map set tuple object obj any void none null nil undefined unit self promise optional option result usize isize u8 u16 u32 "
    "u64 i8 i16 i32 i64 f32 f64 error err iterable iterator sequence callable type bigint symbol never unknown".split()
)
_EMPTY_RESULT = frozenset("return returns returned value values result results".split())

_PLACEHOLDER = regex.compile(
    r"""(?ix)^(?:
      (?:no|missing|needs?|lacks?|add(?:\s+(?:some|a|an|the))?|insert|write(?:\s+(?:some|the))?|without|provide)\s+(?:\w+\s+)?
        (?:docs?|documentation|description|comments?|docstring|javadoc|jsdoc|summary)(?:\s+(?:here|later|yet|available|provided|given|please|me|now))*
    | (?:docs?|documentation|description|comments?|docstring|summary)\s+(?:is\s+|are\s+)?(?:missing|pending|needed|wanted|goes?\s+here|to\s+(?:come|follow)|here|tbd|todo|later)
    | (?:not\s+(?:yet\s+)?|un)documented(?:\s+yet)?
    | (?:please\s+)?(?:document|describe|explain|comment)(?:\s+(?:me|this|it|here|params?|parameters|function|method|later|us))*
    | (?:please\s+)?fill\s+(?:me\s+)?in(?:\s+later)?
    | (?:write|insert|add)\s+(?:me|docs?|something|here)(?:\s+here)?
    | to\s+be\s+(?:done|determined|defined|written|documented|described|decided|added|announced|completed|filled\s+in)
    | (?:your\s+)?(?:description|docs?|documentation|comment|summary|text|placeholder|stub|dummy|untitled|blank|empty)(?:\s+(?:text|here|goes\s+here))?
    | lorem\s+ipsum.*
    | t\.?\s?b\.?\s?[dca] | w\.?i\.?p | n\s*/\s*a | none | nil | null | xxx+ | foo | bar | asdf\w* | etc | tk | work\s+in\s+progress | coming\s+soon
    | (?:todo\s+)?auto[- ]?generated\s+(?:method|function|constructor|class|catch|code)?\s*(?:stub|block)?
    )$"""
)
# the same in other languages: nothing there, to come, or to be found elsewhere
_ELSEWHERE = regex.compile(
    r"""(?ix)^(?:
      siehe\s+(?:auch\s+)?(?:oben|unten|dort|hier|vorher|darüber|darunter|README\S*|(?:die\s+)?dokumentation) | wie\s+oben | (?:keine|ohne|fehlende)\s+(?:beschreibung|dokumentation|doku)(?:\s+(?:vorhanden|verfügbar))?
    | (?:beschreibung|dokumentation|doku)\s+(?:fehlt|folgt)(?:\s+noch)? | (?:noch\s+)?(?:nicht|un)\s*dokumentiert | noch\s+zu\s+(?:dokumentieren|beschreiben|ergänzen)
    | voir\s+(?:plus\s+(?:haut|bas|loin)|ci-dessus|ci-dessous|README\S*|la\s+documentation) | (?:pas\s+de|aucune|sans)\s+(?:description|documentation|commentaire)s?(?:\s+disponible)? | non\s+documentée? | à\s+(?:faire|compléter|documenter|définir|remplir)
    | (?:ver|véase|veja)\s+(?:más\s+)?(?:arriba|abajo|acima|abaixo|README\S*|la\s+documentación|a\s+documentação) | sin\s+(?:descripción|documentación|documentar) | por\s+(?:hacer|definir|documentar|completar) | pendiente(?:\s+de\s+documentar)?
    | sem\s+(?:descrição|documentação) | a\s+(?:fazer|documentar) | não\s+documentado | no\s+documentado
    | vedi\s+(?:sopra|sotto|README\S*) | (?:nessuna|senza)\s+(?:descrizione|documentazione) | da\s+(?:fare|documentare|completare|definire) | non\s+documentat[oa]
    | zie\s+(?:boven|onder|hierboven|hieronder) | geen\s+(?:beschrijving|documentatie) | patrz\s+(?:wyżej|niżej|powyżej|poniżej) | brak\s+(?:opisu|dokumentacji) | do\s+uzupełnienia
    | (?:(?:см|смотри|смотрите)\.?\s+)?(?:выше|ниже|README\S*|документацию) | см | (?:нет|без)\s+(?:описания|документации) | описание\s+отсутствует | не\s+(?:за)?документировано | то\s+же,?\s+что\s+(?:и\s+)?выше
    | 待补充 | 待完善 | 待定 | 待写 | 待办 | 暂无(?:说明|描述|文档|注释)? | (?:没有|无)(?:说明|描述|文档|注释) | 见[上下]文? | 参见[上下]文 | 同上 | 未完待续
    | (?:説明|ドキュメント|記述|コメント)(?:なし|無し|はありません|未記載) | 未記入 | 未定 | (?:上記|下記|以下|前述|後述)(?:を|の説明を)?参照(?:してください|のこと)? | 後で書く
    | (?:설명|문서|주석)\s*없음 | (?:위|아래)\s*참조 | 위와\s*같음 | 추후\s*작성
    )$"""
)
# a marker that makes the rest of its sentence a note to its author
_TODO = regex.compile(
    r"""(?x)^(?:@?(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b
      | (?i:todo|fixme|xxx|hack|tbd|wip|to[ -]do)\s*(?:\([^)]*\)|\[[^\]]*\])*\s*(?:[:\-–—]|$|(?i:explain|document|describe|write|add|fill|complete|finish|implement)\b)
      | (?i:todo|fixme)\s*[(\[])"""
)
_POINTER = regex.compile(
    r"""(?ix)^(?:
      see\b.* | cf\b.* | (?:same|as)\s+(?:as\s+)?(?:above|below|before|in|for)\b.* | same\s+as\s+\S+ | ditto | idem
    | (?:please\s+)?refer\s+to\b.* | (?:documented|described|explained|defined)\s+(?:in|at|above|below|elsewhere)\b.*
    | (?:inherited|copied)\s+(?:doc|docs|documentation|from)\b.* | \{?@?inherit\s?doc\}? | \{@(?:link|see)\b[^}]*\}
    | (?:https?|ftp)://\S+ | \S+\.(?:md|txt|rst|html?) | for\s+(?:more\s+)?(?:details|information|docs)\b.*
    )$"""
)
_DIRECTIVE = regex.compile(
    r"""(?ix)^(?:
      @?(?:eslint|tslint|jshint|jslint|jscs|prettier|istanbul|c8|v8|pylint|flake8|mypy|pyright|pyre|yapf|isort|rustfmt|clippy|
        nolint|nosonar|nosec|checkstyle|noinspection|ktlint|detekt|rubocop|swiftlint|clang-format|cspell|stylelint|biome|
        deno-lint|deno-fmt|ruff|bandit|codeql|lgtm|sonar|spotless|spotbugs|findbugs|pmd|golangci|revive|staticcheck|sourcery|
        dprint|oxlint|standard)(?:[-:\[(=].*|\s+(?:disable|enable|allow|ignore|skip|off|on|exempt)\b.*|\s*$)
    | (?:eslint|pylint|prettier|rustfmt|clippy|istanbul|c8|v8|flake8|jshint|jslint|tslint|nolint|nosonar)\b.*
    | noqa\b.* | type:\s*ignore\b.* | pragma[:\s]\s*(?:no|once|cover|allow|warning|region)\b.* | fmt:\s*(?:off|on|skip)
    | coverage:\s*\S+.* | go:\w+.* | \+build\b.* | line\s+\S+:\d+ | @formatter:(?:on|off) | formatter:(?:on|off)
    | @ts-\S+.* | @(?:flow|jsx|jest-environment|vite-ignore|babel|preserve|license|nocheck|noflow|format|strict|suppress\w*)\b.*
    | suppress\s?(?:warnings|lint)\b.* | -\*-.*-\*- | vim?:.* | language=\S+ | (?:un)?safe:\s*ignore | checkstyle:\S+ | skipcq\b.*
    | \#?!?\[?(?:allow|deny|warn|cfg|derive|inline)\([^)]*\)\]?
    )$"""
)
_NOTICE = regex.compile(
    r"""(?ix)^(?:
      (?:©|\(c\)|copyright|copr\.?)\b.* | ©.* | all\s+rights?\s+reserved\b.* | spdx-\S+.* | licen[sc]ed\s+(?:under|to)\b.* | licen[sc]e\s*:.*
    | released\s+under\b.* | (?:mit|apache|bsd|gpl|mpl|isc)(?:[\s\-\d.]+(?:clause)?)?\s+licen[sc]e\b.*
    | permission\s+is\s+hereby\s+granted\b.* | redistribution\s+and\s+use\b.* | this\s+(?:program|file|library|software)\s+is\s+(?:free|licensed|distributed|part\s+of|provided)\b.*
    | (?:you\s+may|you\s+should\s+have)\s+(?:not\s+use\s+this|obtain\s+a|received\s+a)\b.* | unless\s+required\s+by\s+applicable\b.*
    | (?:use\s+of|distribution\s+of)\s+this\s+source\s+code\b.* | the\s+(?:above\s+copyright|software\s+is\s+provided)\b.*
    | distributed\s+(?:under|on|in)\b.*(?:licen[sc]e|basis|hope).* | without\s+warrant(?:y|ies)\b.*
    | (?:written|created|authored|maintained|modified|contributed|added|developed)\s+(?:by|on|at|in)\b(?=.*(?:\d|\p{Lu}|@)).*
    | (?:authors?|maintainers?|contributors?|owner|created|modified|date|updated|last\s+(?:modified|updated|changed|edited)|version|revision|since|history|changelog)\s*:.*
    | last\s+(?:modified|updated|changed|edited)\b.* | since\s+v?\d[\w.]* | version\s+v?\d[\w.]* | v?\d+(?:\.\d+)+\S*
    | \d{4}[-/.]\d{1,2}[-/.]\d{1,2}.* | \$(?:Id|Revision|Date|Author|Header)\b.*
    | (?:this\s+)?(?:(?:file|method|function|class|code|source|module|comment|stub|documentation)\s+)?(?:was|is|has\s+been)?\s*(?:auto(?:matically)?[- ]?)?generated\s+(?:by|from|with|using|on|at|code|file|automatically|source|stub|method)\b.*
    | (?:code|file|class|method|function)\s+(?:auto(?:matically)?[- ]?)?generated\b.* | auto(?:matically)?[- ]?generated(?:\s+(?:by|from|with|file|code|at|on|using|do\s+not)\b.*)? | generated
    | (?:please\s+)?(?:do\s+not|don'?t)\s+(?:edit|modify|change|touch)(?:\s+(?:this|it|by|manually|the|file|code|directly|or)\b.*)?
    | (?:any\s+)?(?:manual\s+)?changes\s+will\s+be\s+(?:lost|overwritten)\b.*
    )$"""
)
_HEAD = regex.compile(
    r"""(?ix)^(?:args?|arguments?|param(?:eter)?s?|kwargs|inputs?|outputs?|return(?:s|\s+values?|\s+type)?|raises?|throws|exceptions?|errors?|panics|safety|
      yields?|receives?|examples?|usage|notes?|remarks?|see(?:\s+also)?|warnings?|warns?|attributes?|properties|fields|members|
      description|summary|overview|details?|synopsis|references?|todo|tests?|type\s+parameters|preconditions?|postconditions?|complexity)\s*:*$"""
)
_TAG = regex.compile(
    r"""(?x)^(?:[@\\](?P<tag>[A-Za-z][\w.-]*)(?![\w-]*:)|:(?P<field>param|parameter|arg|argument|key|keyword|return|returns|rtype|raise|raises|except|
      exception|type|var|ivar|cvar|vartype|yield|yields|ytype|meta|author|since|deprecated|see)\b(?P<of>[^:\n]*):)\s*(?P<rest>.*)$"""
)
_NAMED = frozenset("param parameter arg argument key keyword property prop field var ivar cvar tparam template typeparam typedef".split())
_RAISED = frozenset("throws throw exception raise raises except".split())
_RESULT = frozenset("return returns yield yields retval result".split())
_TOLD = frozenset("brief details detail note remark remarks description desc summary abstract apinote implnote implspec warning pre post invariant attention classdesc deprecated example todo2 usage".split())
_CODE = [
    regex.compile(p)
    for p in (
        r"^(?:let|const|var|val|auto|final|static|mut|int|long|short|byte|char|float|double|boolean|bool|String|string|usize|u?int\d+|size_t|List<.*>|Map<.*>)\s+(?:mut\s+)?[\w$]+(?:\s*:\s*[\w<>\[\], |&]+)?\s*(?::?=\s*\S.*|;)$",
        r"^[\w$.\[\]*&]+(?:\s*,\s*[\w$.]+)*\s*(?::=|(?:[-+*/%|&^]|<<|>>|\*\*|//)?=(?![=>]))\s*(?!.*\b\p{Ll}+ \p{Ll}+ \p{Ll}+\b)\S.*$",
        r"^return(?:\s+(?:[\w$.\[\]\"'&*!-]+(?:\(.*\))?(?:\s*(?:[-+*/%<>=&|?:]+|and|or|not)\s*[\w$.\[\]\"']+(?:\(.*\))?)*))?\s*;?$",
        r"^(?:await\s+|yield\s+|new\s+|throw\s+|raise\s+|del\s+|defer\s+|go\s+)?[\w$.:]+(?:<[^>]*>)?!?\(.*\)\s*;$",
        r"^(?:await\s+|self\.|this\.)?[\w$]+(?:\.[\w$]+)*\([^()]*(?:\([^()]*\)[^()]*)*\)$",
        r"^(?:if|for|while|switch|match|else|elif|try|catch|finally|except|with|do|loop|unsafe)\b.*[{:]\s*$",
        r"^(?:if|for|while|switch)\s*\(.*\)\s*(?:.*;)?\s*\{?$",
        r"^[{}()\[\];,\s]+$",
        r"^(?:import|package|use|using|require|include)\s+[\w.:{}*,\s\"'<>/]+;$",
        r"^import\s+[\w.]+(?:\s+as\s+\w+)?$|^from\s+[\w.]+\s+import\s+[\w*, ]+$|^import\s*[({\"'].*$",
        r"^(?:export\s+|pub(?:\(.*\))?\s+|public\s+|private\s+|protected\s+|static\s+|async\s+)*(?:def|fn|func|function|class|struct|enum|interface|trait|impl|type)\s+[\w$<>]+\s*(?:[({:=].*)$",
        r"^(?:break|continue|pass)\s*;?$",
        r"^.*[\w)\]}\"']\s*;$(?<=[=(){}\[\]].*)",
        r"^\}\s*(?:else|catch|finally|while).*$",
        r"^@\w+\(.*\)$",
    )
]


_LINES = regex.compile(r"\r\n|\r|\n")
_LETTER = regex.compile(r"\p{L}")
_INLINE = regex.compile(r"\{@(?:code|literal|value)\s+([^}]*)\}")
_ENTRY = regex.compile(r"^(?:[-*+•]\s+)?[*`]{0,2}(?P<n>[\w$.*]+)[*`]{0,2}\s*(?:\((?P<t>[^()]*)\))?\s*:(?!:)\s*(?P<d>.*)$")
_NO_ENTRY = regex.compile(
    r"(?i)(?:https?|note|warning|caution|important|returns?|yields?|raises|throws|example|usage|todo|fixme|xxx|hack)$"
)
_OPTIONAL = regex.compile(r",?\s*\b(?:optional|required|default\S*)\b")
_RETURNS = regex.compile(r"(?i)^(?:returns?|yields?|return\s+(?:value|type))\s*:\s*(?P<d>.+)$")
_CODE_HINT = regex.compile(r"[;(){}=\[\]]|^(?:return|break|continue|pass|import|from|if|for|while|else|elif|try|except|finally|with|do|loop|match|switch|case)\b")


def _is_code(s: str) -> bool:
    return bool(_CODE_HINT.search(s)) and any(p.match(s) for p in _CODE)


@lru_cache(65536)
def stem(word: str) -> str:
    """A word without inflection, good enough to see a name's words in prose."""
    w = word.lower()
    if w in ("indices", "index", "indexes", "indexing", "indexed"):
        return "index"
    if w.endswith("ies") and len(w) > 4:
        w = w[:-3] + "y"
    elif w.endswith(("ches", "shes", "xes", "sses", "zes")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 3:
        w = w[:-1]
    for end in ("ing", "ied", "ed", "er", "or"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)] + ("y" if end == "ied" else "")
            break
    if w.endswith("e") and len(w) > 3:
        w = w[:-1]
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    if w.endswith("y") and len(w) > 2:
        w = w[:-1] + "i"
    return w


@lru_cache(65536)
def name_stems(name: str) -> frozenset[str]:
    return frozenset(stem(w) for w in _WORD.findall(name or "")) | {(name or "").lower()}


def _only(text: str, known: frozenset[str], words: frozenset[str]) -> bool:
    """Whether all words of a text are known stems, or plain words of the given set or filler."""
    return all(w.lower() in _FILLER or w.lower() in words or stem(w) in known for w in _WORD.findall(text))


def strip_marks(doc: str) -> list[str]:
    """The lines of a comment without its marks and decoration at either end."""
    out = []
    for line in _LINES.split(doc):
        line = line.strip().strip("﻿​")
        if line[:1].isalnum() and line[-1:] not in ("/", '"', "'", ">"):
            out.append(line)
            continue
        for _ in range(4):
            bare = _CLOSE.sub("", _OPEN.sub("", line, count=1)).strip()
            if bare == line:
                break
            line = bare
        out.append(line)
    return out


def _sentence_says(s: str, known: frozenset[str]) -> bool:
    s = s.strip()
    bare = s.strip(" \t*_`~#=-–—.…:;,!?()[]{}<>|\"'•·+/\\^")
    if not _LETTER.search(bare):
        return False
    for p in (_PLACEHOLDER, _ELSEWHERE, _POINTER, _DIRECTIVE, _NOTICE):
        if p.match(bare) or p.match(s):
            return False
    if _TODO.match(s) or _TODO.match(bare) or _HEAD.match(bare):
        return False
    if _is_code(s):
        return False
    return not _only(bare, known, frozenset())


def _described(rest: str, known: frozenset[str], words: frozenset[str]) -> bool:
    rest = rest.strip(" \t-–—:,.;")
    return bool(rest) and not _only(rest, known, words) and _text_says(rest, known)


def _text_says(line: str, known: frozenset[str]) -> bool:
    """Whether a line of prose says something: whole first (notices span sentences), then by sentence."""
    bare = line.strip(" \t*_`~#=-–—.…:;,!?|\"'•·+^")
    if any(p.match(line) or p.match(bare) for p in (_PLACEHOLDER, _DIRECTIVE)) or _is_code(line):
        return False
    return any(_sentence_says(s, known) for s in _SENTENCE.split(line))


def line_says(line: str, known: frozenset[str]) -> bool:
    """Whether one line, without comment marks, says something about behaviour, parameters, result or use."""
    if not line or not _DECOR.sub("", line):
        return False
    if _DIRECTIVE.match(line) or _TODO.match(line):
        return False
    line = _TAG_MARKUP.sub(" ", line)
    line = _INLINE.sub(r" \1 ", line).strip()
    if not _DECOR.sub("", line):
        return False
    m = _TAG.match(line)
    if m:
        tag, rest = (m["tag"] or m["field"]).lower(), m["rest"]
        rest = regex.sub(r"^\s*(?:\{(?:[^{}]|\{[^{}]*\})*\}|\[[^\]]*\](?=\s*$))", "", rest).strip()
        if tag in _NAMED:
            if m["field"]:
                names = m["of"]
            else:
                got = regex.match(r"(?:\[?[\w$.\[\]<>*&]+(?:=[^\]\s]*)?\]?)", rest)
                names = got[0] if got else ""
                rest = rest[len(names) :]
                rest = regex.sub(r"^\s*(?:\{[^}]*\}|\([^)]*\))", "", rest)
            return _described(rest, frozenset(stem(w) for w in _WORD.findall(names)), _TYPES)
        if tag in _RAISED:
            rest = rest if m["field"] else regex.sub(r"^[\w$.]+", "", rest)
            return _described(rest, frozenset(), _TYPES)
        if tag in _RESULT:
            return _described(rest, frozenset(), _TYPES | _EMPTY_RESULT)
        if tag in _TOLD:
            return bool(rest) and line_says(rest, known)
        return False
    m = _ENTRY.match(line)
    if m and not _NO_ENTRY.match(m["n"]):
        d = _OPTIONAL.sub("", m["d"]).strip()
        if not d or _only(d, frozenset(stem(w) for w in _WORD.findall(m["n"])), _TYPES):
            return False if _sentence_is_bare(line) else _text_says(line, known) and not _only(m["n"], known, _TYPES)
        return _text_says(line, known)
    m = _RETURNS.match(line)
    if m:
        return _described(m["d"], known, _TYPES | _EMPTY_RESULT)
    return _text_says(line, known)


def _sentence_is_bare(line: str) -> bool:
    """A name with at most a type behind a colon, as in the entries of a parameter list."""
    return bool(regex.match(r"^(?:[-*+•]\s+)?[\w$.*`]+\s*(?:\([^()]*\))?\s*:\s*[\w$.\[\]<>|, ]*$", line))


def says_something(doc: str | None, name: str | None) -> bool:
    """Whether a documentation comment says something in any of its lines."""
    if not doc:
        return False
    known = name_stems(name or "")
    return any(line_says(line, known) for line in strip_marks(doc))


def description(doc: str | None, name: str | None) -> str:
    """The lines that say something, without comment marks; empty where the documentation is trivial."""
    if not doc:
        return ""
    known = name_stems(name or "")
    return "\n".join(line for line in strip_marks(doc) if line_says(line, known))


# ---------------------------------------------------------------- code

# what is protected while braces are balanced: %s is what the family has besides (quotes and, in scripts, patterns)
_PARTS = rb"""(?(DEFINE)
  (?<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|\br\#"(?:[^"]|"(?!\#))*+"\#|"(?:[^"\\\n]|\\.)*+"|`(?:[^`\\]|\\.)*+`|%s)
  (?<com>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|//[^\n]*+)
  (?<par>\((?:[^()"'`/]++|(?&com)|(?&str)|["'`/]|(?&par))*+\))
  (?<blk>\{(?:[^{}"'`/]++|(?&com)|(?&str)|["'`/]|(?&blk))*+\})
)"""
# heads of blocks that are no functions: they are skipped before their bodies are balanced
_NO_HEAD = rb"""(?!(?:(?:export|default|declare|pub(?:\([^)\n]*\))?|public|private|protected|internal|static|final|abstract|sealed|unsafe|strictfp)\s++)*+
  (?:if|for|while|switch|match|else|catch|try|do|loop|return|throw|class|interface|enum|struct|union|impl|trait|mod|module|namespace|type|package|import|use|case|select|go|defer|synchronized|@interface|record)\b)"""
# a signature is a line up to its parameters (or an arrow), and goes on behind them on lines that continue it
_WHOLE = (
    rb"^[ \t]*+(?<comment>(?:(?&com)\s*+)*+)" + _NO_HEAD
    + rb"""(?<signature>(?=[\w$\#*@\[])(?:@[\w.]++(?&par)?+\s*+|\#\[[^\]\n]*+\]\s*+)*+(?:[^{}()"'`;/\n]++|(?&com)|(?&str)|[/'])*+(?:(?&par)|(?<==>)|(?<==>\s))
      (?:[^{}()"'`;/\n]++|(?&par)|(?&com)|(?&str)|[/']|\n(?=\s*+(?:where\b|throws\b|->|=>|[:{,&|]))|(?<=[,=:>|&]|[,=:>|&]\r|where|where\r)\n)*+)(?<body>(?&blk))"""
)
_CHAR = rb"'(?:[^'\\\n]|\\[^\n][^'\n]*+)'"
_QUOTED = rb"'(?:[^'\\\n]|\\.)*+'|(?<=[=(,:\[!&|?{};>]\s?)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
_BRACES = regex.compile(_PARTS % _CHAR + _WHOLE, regex.S | regex.X | regex.M)
_SCRIPT = regex.compile(_PARTS % _QUOTED + _WHOLE, regex.S | regex.X | regex.M)
# the same strings and comments for one pass over a text; the standard library is faster where nothing recurs
_LONG = rb"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*+\"\"\""
_REST = rb"|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|//[^\n]*+"
_HIDDEN_BRACES = re.compile(_LONG + rb"|\br#\"(?:[^\"]|\"(?!#))*+\"#|\"(?:[^\"\\\n]|\\.)*+\"|`(?:[^`\\]|\\.)*+`|" + _CHAR + _REST, re.S)
_HIDDEN_SCRIPT = re.compile(
    rb"\"(?:[^\"\\\n]|\\.)*+\"|`(?:[^`\\]|\\.)*+`|'(?:[^'\\\n]|\\.)*+'" + _REST
    + rb"|(?:(?<=[=(,:\[!&|?{};>])|(?<=[=(,:\[!&|?{};>]\s))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/", re.S,
)
_HIDDEN_INDENT = re.compile(_LONG + rb"|'''(?:[^'\\]|\\.|'(?!''))*+'''|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|#[^\n]*+", re.S)
_INDENT = regex.compile(
    rb"""\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|\#[^\n]*+""", regex.S | regex.X
)
_INDENT = regex.compile(
    rb"""(?(DEFINE)
  (?<str>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*+'''|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
  (?<par>[(\[{](?:[^()\[\]{}"'\#]++|(?&str)|\#[^\n]*+|["']|(?&par))*+[)\]}])
)^(?<comment>(?:[ \t]*+\#[^\n]*+\n)*+)(?<ind>[ \t]*+)(?<signature>(?:@[^\n]*+\n\s*+)*+(?:async\s++)?def\s++\w++\s*+(?:\[[^\]]*+\])?(?&par)[^:\n]*+:)
(?<body>(?:(?&par)|(?&str)|\#[^\n]*+|[^\n()\[\]{}"'\#]++|["'(\[{)\]}]|\n(?=[ \t]*+(?:\r?\n|\#|\Z)|(?P=ind)[ \t]))*+)""",
    regex.S | regex.X | regex.M,
)


def _bare(data: bytes, hidden: re.Pattern) -> tuple[bytes, list[tuple[int, int]]]:
    """A text with comments blanked and strings made quotes alone, and where these lie: one pass."""
    out, parts, at = [], [], 0
    for m in hidden.finditer(data):
        comment = data[m.start() : m.start() + 1] == b"#" or data[m.start() : m.start() + 2] in (b"//", b"/*")
        out += [data[at : m.start()], (b" " if comment else b'"') * (m.end() - m.start())]
        at = m.end()
        parts.append((m.start(), at))
    return b"".join([*out, data[at:]]), parts


def _partners(bare: bytes) -> dict[int, int]:
    """Every opening bracket's closing one; what does not close is not there."""
    out: dict[int, int] = {}
    stack: list[tuple[bytes, int]] = []
    for m in regex.finditer(rb"[(){}]", bare):
        if m[0] in b"({":
            stack.append((m[0], m.start()))
        elif stack and stack[-1][0] + m[0] in (b"()", b"{}"):
            out[stack.pop()[1]] = m.start()
        elif m[0] == b"}":  # an open parenthesis ends with the block around it
            while stack and stack[-1][0] == b"(":
                stack.pop()
            if stack:
                out[stack.pop()[1]] = m.start()
    return out


_STOP = regex.compile(rb"[(){};\n]")
_GOES_ON = regex.compile(rb"\s*+(?:where\b|throws\b|->|=>|[:{,&|])")
_GOING_ON = regex.compile(rb"(?:[,=:>|&]|\bwhere)\Z")
_DEF = regex.compile(rb"^[ \t]*+(?:async[ \t]++)?def[ \t]++\w++[ \t]*+(?:\[[^\]\n]*+\])?\(", regex.M)


def functions(data: bytes, language: str) -> dict[int, regex.Match]:
    """The functions that the language's pattern finds in a text, by where their bodies start.

    Every line is tried as the beginning of a comment, signature and balanced body; of several beginnings of one body
    the first, with the whole run of comments, counts. Functions within functions are found too. A pass over the
    brackets tells beforehand which lines lead to a body that closes, so the pattern never runs to the end of a
    damaged text in vain, and each body is matched once.
    """
    found: dict[int, regex.Match] = {}
    if language == "python":
        bare, _ = _bare(data, _HIDDEN_INDENT)
        close = _partners(bare)
        for d in _DEF.finditer(bare):
            if d.end() - 1 not in close:
                continue
            at = d.start()
            while at:  # comments and decorators right before it
                line = data.rfind(b"\n", 0, at - 1) + 1
                if not data[line:at].lstrip().startswith((b"#", b"@")):
                    break
                at = line
            while at <= d.start():
                if m := _INDENT.match(data, at):
                    found.setdefault(m.start("body"), m)
                    break
                at = data.find(b"\n", at) + 1 or len(data) + 1
        return found
    script = language in ("javascript", "typescript", "jsx", "tsx")
    pattern = _SCRIPT if script else _BRACES
    bare, hidden = _bare(data, _HIDDEN_SCRIPT if script else _HIDDEN_BRACES)
    close = _partners(bare)
    starts = [0, *(m.end() for m in regex.finditer(rb"\n", data))]
    done: set[int] = set()
    h = 0
    for line in starts:
        while h < len(hidden) and hidden[h][1] <= line:
            h += 1
        if h < len(hidden) and hidden[h][0] < line:
            continue  # within a comment or string
        at = begin = row = line
        while m := _STOP.search(bare, at):
            if m[0] == b"(" and m.start() in close:
                at = close[m.start()] + 1
            elif m[0] == b"\n":
                head = bare[begin : m.start()].strip()
                if not head or head.startswith((b"@", b"#[")):
                    begin = m.end()  # comments and annotations before the signature
                elif not _GOES_ON.match(bare, m.end()) and not _GOING_ON.search(bare[row : m.start()].rstrip()[-6:]):
                    break
                at = row = m.end()
            else:
                break
        if not m or m[0] != b"{" or m.start() not in close or m.start() in done:
            continue
        got = pattern.match(data, line, close[m.start()] + 1)
        if got:
            found.setdefault(got.start("body"), got)
            done.add(m.start())
    return found


def captured(found: dict[int, regex.Match], data: bytes, start: int, body_start: int, end: int) -> dict:
    """Comment, signature and body of one of the found functions, or, where none has its body there, by its span."""
    m = found.get(body_start)
    if m:
        return {k: m[k].decode("utf-8", "replace").strip() for k in ("comment", "signature", "body")} | {"by": "pattern"}
    return {
        "comment": "", "signature": data[start:body_start].decode("utf-8", "replace").strip(),
        "body": data[body_start:end].decode("utf-8", "replace"), "by": "span",
    }


PAIRS = (
    "symbol_id string, file_id string, language string, name string, kind string, description string, "
    "comment string, signature string, body string, cut_by string"
)
REGION, BEFORE = 16_384, 4_096


def pairs(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Code-description pairs of functions and methods: see ``PAIRS`` for the columns.

    A symbol counts when its kind is function or method, its body span is not null and its documentation says
    something (``says_something``). Repeated rows count once; symbols with null id are left out; a symbol whose
    file has no snapshot, or whose span lies outside it, has null code. Of several snapshots of one file the
    greatest content counts. Other columns are ignored. The symbols of one file meet its text in regions of
    ``REGION`` bytes, each cut to its symbols' spans and what stands before them, so a hot file is spread over many
    rows, no group grows without bound, and a file goes through Arrow about once, however long it is.
    """
    wanted = symbols.where(
        F.col("kind").isin("function", "method")
        & F.col("body_start_byte").isNotNull() & F.col("doc_comment").isNotNull() & F.col("symbol_id").isNotNull()
    )
    span = F.coalesce("start_byte", "body_start_byte")
    end = F.coalesce("body_end_byte", "end_byte", "body_start_byte")
    # rows that can meet no text stay alone: nulls never gather in one group
    alone = F.when(F.col("file_id").isNull() | span.isNull(), F.xxhash64("symbol_id"))
    # a comment with its marks and indents is before its function; one that is longer comes as recorded
    before = F.greatest(span - 2 * F.octet_length("doc_comment") - BEFORE, F.lit(0))
    groups = wanted.select(
        "file_id", F.floor(span / REGION).alias("region"), alone.alias("alone"), before.alias("lo"), end.alias("hi"),
        F.struct(
            "symbol_id", "language", "name", "kind", "doc_comment", span.alias("start"), F.col("body_start_byte").alias("body"), end.alias("end"),
        ).alias("s"),
    ).groupBy("file_id", "region", "alone").agg(F.collect_set("s").alias("symbols"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    text = snapshots.where("file_id is not null").groupBy(F.col("file_id").alias("fid")).agg(F.max("content").alias("content"))
    whole = F.col("content").cast("binary")
    part = F.when(F.col("hi") >= F.col("lo"), F.substring(whole, (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int")))
    joined = groups.join(text, groups["file_id"] == text["fid"], "left").select("file_id", "symbols", "lo", part.alias("part"), F.octet_length("content").alias("size"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in PAIRS.split(", ")]
        schema = pa.schema([(n, pa.string()) for n in names])
        for b in batches:
            rows: list[dict] = []
            for file_id, symbols_, lo, data, size in zip(*(b.column(i).to_pylist() for i in range(5))):
                found: dict[str, dict] = {}
                for s in symbols_:
                    told = description(s["doc_comment"], s["name"])
                    if not told:
                        continue
                    row = {"symbol_id": s["symbol_id"], "file_id": file_id, "language": s["language"], "name": s["name"],
                           "kind": s["kind"], "description": told}
                    if data is not None and 0 <= s["start"] <= s["body"] <= size:
                        lang = s["language"] or ""
                        if lang not in found:
                            found[lang] = functions(data, lang)
                        c = captured(found[lang], data, s["start"] - lo, s["body"] - lo, s["end"] - lo)
                        row |= {"comment": c["comment"] or s["doc_comment"], "signature": c["signature"], "body": c["body"], "cut_by": c["by"]}
                    else:
                        row |= {"comment": s["doc_comment"]}
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return joined.mapInArrow(run, PAIRS)
