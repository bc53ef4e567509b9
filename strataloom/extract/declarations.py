"""Declarations, imports and heritage of each language as patterns over masked text.

A row is (kind, pattern). ``name`` is the declared name; ``sup`` its bases, ``type`` its type, ``params`` its
parameters. Patterns see neither comments nor strings.
"""

from __future__ import annotations

_ID = r"[\p{L}_$][\p{L}\p{N}_$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|partial|readonly|open|export|default|declare|suspend|inline|data|native|synchronized|unsafe|extern|const|case|implicit|lazy|external|fileprivate|mutating|required|convenience|late|factory|covariant|operator|infix|tailrec|inner|annotation|value|transient|volatile|strictfp)\s+)*"


def _script() -> list[tuple[str, str]]:
    return [
        ("class", rf"^[ \t]*{_MODS}class\s+(?P<name>{_ID})(?:<[^{{]*>)?(?:\s+extends\s+(?P<sup>[\p{{L}}\w$.<>, ]+?))?(?:\s+implements\s+[^{{]+)?\s*\{{"),
        ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>{_ID})(?:<[^{{]*>)?(?:\s+extends\s+(?P<sup>[^{{]+?))?\s*\{{"),
        ("enum", rf"^[ \t]*{_MODS}enum\s+(?P<name>{_ID})"),
        ("type", rf"^[ \t]*{_MODS}type\s+(?P<name>{_ID})(?:<[^=]*>)?\s*="),
        ("namespace", rf"^[ \t]*{_MODS}(?:namespace|module)\s+(?P<name>[\p{{L}}\w$.]+)\s*\{{"),
        ("function", rf"^[ \t]*{_MODS}function\s*\*?\s*(?P<name>{_ID})\s*(?:<[^(]*>)?(?P<params>\([^)]*\))(?:\s*:\s*(?P<type>[^{{;]+))?"),
        ("function", rf"^[ \t]*{_MODS}(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?P<params>\([^)]*\)|{_ID})\s*(?::[^=]+)?=>)"),
        ("method", rf"^[ \t]+{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>#?{_ID})\s*(?:<[^(]*>)?(?P<params>\([^)]*\))(?:\s*:\s*(?P<type>[^{{;]+))?\s*\{{"),
        ("signature", rf"^[ \t]+{_MODS}(?P<name>{_ID})\??\s*(?:<[^(]*>)?(?P<params>\([^)]*\))(?:\s*:\s*(?P<type>[^{{;\n]+))?;?[ \t\r]*$"),
        ("constant", rf"^{_MODS}const\s+(?P<name>{_ID})\s*(?::\s*(?P<type>[^=]+))?=\s*(?!\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>))"),
        ("variable", rf"^{_MODS}(?:let|var)\s+(?P<name>{_ID})\s*(?::\s*(?P<type>[^=;]+))?"),
        ("import", r"^[ \t]*import\s+[^;\n]*?from\s*(?P<name>[\"'][^\"']*[\"'])"),
    ]


_JVM = [
    ("module", r"^[ \t]*package\s+(?P<name>[\w.]+)"),
    ("import", r"^[ \t]*import\s+(?:static\s+)?(?P<name>[\w.*]+)"),
    ("interface", rf"^[ \t]*{_MODS}(?:interface|@interface)\s+(?P<name>{_ID})(?:<[^{{]*>)?(?:\s+extends\s+(?P<sup>[^{{]+?))?\s*\{{"),
    ("enum", rf"^[ \t]*{_MODS}enum\s+(?:class\s+)?(?P<name>{_ID})"),
]
_JAVA_LIKE_METHOD = rf"^[ \t]+{_MODS}(?:<[^>]+>\s+)?(?P<type>(?!(?:return|else|new|throw|case|await|yield|assert|do|in|goto|using)\b)[\p{{L}}\w$.]+(?:<[^(]*?>)?(?:\[\])*\??)\s+(?P<name>{_ID})\s*(?P<params>\([^)]*\))(?:\s*throws\s+[\w., ]+)?\s*(?:\{{|;|=>)"

DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>{_ID})\s*(?:<[^(]*>)?(?P<params>\([^)]*\))(?:\s*->\s*(?P<type>[^{{;]+))?"),
        ("struct", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>{_ID})"), ("enum", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{_ID})"),
        ("union", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?union\s+(?P<name>{_ID})"),
        ("trait", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>{_ID})(?:\s*:\s*(?P<sup>[^{{]+))?"),
        ("class", rf"^[ \t]*(?:unsafe\s+)?impl(?:<[^{{]*?>)?\s+(?:(?P<sup>[\w:<>, ]+)\s+for\s+)?(?P<name>[\w:]+)"),
        ("module", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>{_ID})"), ("type", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{_ID})"),
        ("constant", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>{_ID})\s*:\s*(?P<type>[^=;]+)"),
        ("function", rf"^[ \t]*macro_rules!\s*(?P<name>{_ID})"), ("import", r"^[ \t]*(?:pub\s+)?use\s+(?P<name>[\w:{},*\s]+?);"),
    ],
    "go": [
        ("module", r"^package\s+(?P<name>\w+)"), ("import", r"^\s*(?:import\s+)?(?:\w+\s+)?(?P<name>\"[^\"]*\")\s*$"),
        ("function", r"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?(?P<params>\([^)]*\))\s*(?P<type>[^{\n]*)"),
        ("method", r"^func\s+\((?:\w+\s+)?\*?(?P<sup>\w+)[^)]*\)\s*(?P<name>\w+)\s*(?P<params>\([^)]*\))\s*(?P<type>[^{\n]*)"),
        ("signature", r"^[ \t]+(?P<name>[\p{L}_]\w*)(?P<params>\([^)]*\))[ \t]*(?P<type>[\w*.\[\] (),]*)\r?$"),
        ("struct", r"^[ \t]*(?:type\s+)?(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^[ \t]*(?:type\s+)?(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)(?P<type>[^\n]+)"), ("constant", r"^const\s+(?P<name>\w+)"), ("variable", r"^var\s+(?P<name>\w+)"),
    ],
    "java": [*_JVM, ("class", rf"^[ \t]*{_MODS}(?:class|record)\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\([^)]*\))?(?:\s+extends\s+(?P<sup>[\w.<>, ]+?))?(?:\s+implements\s+[^{{]+)?\s*\{{"),
             ("method", _JAVA_LIKE_METHOD), ("constructor", rf"^[ \t]+(?:(?:public|private|protected)\s+)?(?P<name>\p{{Lu}}\w*)\s*(?P<params>\([^)]*\))(?:\s*throws\s+[\w., ]+)?\s*\{{"),
             ("field", rf"^[ \t]+{_MODS}(?P<type>[\p{{L}}\w$.]+(?:<[^=;]*?>)?(?:\[\])*)\s+(?P<name>{_ID})\s*(?:=[^;]*)?;")],
    "csharp": [("namespace", r"^[ \t]*namespace\s+(?P<name>[\w.]+)"), ("import", r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?P<name>[\w.=\s]+);"),
               ("class", rf"^[ \t]*{_MODS}(?:class|record(?:\s+struct)?)\s+(?P<name>{_ID})(?:<[^{{]*?>)?(?:\([^)]*\))?(?:\s*:\s*(?P<sup>[^{{;]+?))?\s*[{{;]"), ("struct", rf"^[ \t]*{_MODS}struct\s+(?P<name>{_ID})"),
               ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>{_ID})(?:\s*:\s*(?P<sup>[^{{]+?))?"), ("enum", rf"^[ \t]*{_MODS}enum\s+(?P<name>{_ID})"), ("delegate", rf"^[ \t]*{_MODS}delegate\s+[\w<>\[\]?]+\s+(?P<name>{_ID})"),
               ("method", _JAVA_LIKE_METHOD), ("property", rf"^[ \t]+{_MODS}(?P<type>[\w.<>\[\]?,]+)\s+(?P<name>{_ID})\s*(?:\{{\s*(?:get|set|init)|=>)"), ("event", rf"^[ \t]+{_MODS}event\s+[\w<>]+\s+(?P<name>{_ID})")],
    "kotlin": [*_JVM, ("class", rf"^[ \t]*{_MODS}(?:class|object)\s+(?P<name>{_ID})(?:<[^{{(]*>)?(?:\([^)]*\))?(?:\s*:\s*(?P<sup>[^{{\n]+))?"),
               ("function", rf"^[ \t]*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>.?]+\.)?(?P<name>{_ID}|`[^`]+`)\s*(?P<params>\([^)]*\))(?:\s*:\s*(?P<type>[^={{\n]+))?"), ("property", rf"^[ \t]*{_MODS}va[lr]\s+(?P<name>{_ID})(?:\s*:\s*(?P<type>[^=\n]+))?")],
    "scala": [*_JVM, ("class", rf"^[ \t]*{_MODS}(?:class|object|case\s+class|case\s+object)\s+(?P<name>{_ID})(?:\[[^\]]*\])?(?:\([^)]*\))?(?:\s+extends\s+(?P<sup>[^{{\n]+))?"), ("trait", rf"^[ \t]*{_MODS}trait\s+(?P<name>{_ID})"),
              ("function", rf"^[ \t]*{_MODS}def\s+(?P<name>{_ID}|[^\s(\[:]+)\s*(?:\[[^\]]*\])?(?P<params>\([^)]*\))?(?:\s*:\s*(?P<type>[^=\n{{]+))?"), ("variable", rf"^[ \t]*{_MODS}va[lr]\s+(?P<name>{_ID})"), ("type", rf"^[ \t]*{_MODS}type\s+(?P<name>{_ID})")],
    "swift": [("import", r"^[ \t]*(?:@\w+\s+)?import\s+(?P<name>[\w.]+)"), ("class", rf"^[ \t]*{_MODS}(?:class|actor|extension)\s+(?P<name>[\w.]+)(?:<[^{{]*>)?(?:\s*:\s*(?P<sup>[^{{]+))?"), ("struct", rf"^[ \t]*{_MODS}struct\s+(?P<name>{_ID})(?:\s*:\s*(?P<sup>[^{{]+))?"),
              ("enum", rf"^[ \t]*{_MODS}(?:indirect\s+)?enum\s+(?P<name>{_ID})"), ("interface", rf"^[ \t]*{_MODS}protocol\s+(?P<name>{_ID})(?:\s*:\s*(?P<sup>[^{{]+))?"), ("function", rf"^[ \t]*{_MODS}func\s+(?P<name>{_ID}|[^\s(<]+)\s*(?:<[^(]*>)?(?P<params>\([^)]*\))(?:[^{{\n]*->\s*(?P<type>[^{{\n]+))?"),
              ("constructor", rf"^[ \t]*{_MODS}(?P<name>init)[?!]?\s*(?P<params>\([^)]*\))"), ("property", rf"^[ \t]*{_MODS}(?:let|var)\s+(?P<name>{_ID})(?:\s*:\s*(?P<type>[^={{\n]+))?"), ("type", rf"^[ \t]*{_MODS}typealias\s+(?P<name>{_ID})")],
    "dart": [("import", r"^[ \t]*(?:import|export|part)\s+(?P<name>[\"'][^\"']*[\"'])"), ("class", rf"^[ \t]*{_MODS}(?:class|mixin|extension)\s+(?P<name>{_ID})(?:<[^{{]*>)?(?:\s+(?:extends|on)\s+(?P<sup>[\w<>., ]+?))?(?:\s+(?:with|implements)\s+[^{{]+)?\s*\{{"), ("enum", rf"^[ \t]*enum\s+(?P<name>{_ID})"),
             ("type", rf"^[ \t]*typedef\s+(?P<name>{_ID})"), ("function", rf"^[ \t]*{_MODS}(?P<type>[\w<>?,\[\] ]+?)\s+(?P<name>{_ID})\s*(?P<params>\([^)]*\))\s*(?:async\*?|sync\*)?\s*(?:\{{|=>)")],
    "c": [("function", rf"^(?:static\s+|inline\s+|extern\s+|const\s+|unsigned\s+|struct\s+)*(?P<type>[\w]+[\s*]+)(?P<name>{_ID})\s*(?P<params>\([^;{{)]*\))\s*\{{"), ("struct", rf"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>{_ID})\s*\{{"), ("enum", rf"^[ \t]*(?:typedef\s+)?enum\s+(?P<name>{_ID})?\s*\{{"),
          ("union", rf"^[ \t]*(?:typedef\s+)?union\s+(?P<name>{_ID})\s*\{{"), ("type", rf"^[ \t]*typedef\s+[^;{{]*?(?P<name>{_ID})\s*;"), ("constant", rf"^[ \t]*#\s*define\s+(?P<name>{_ID})"), ("import", r"^[ \t]*#\s*include\s*(?P<name>[<\"][^>\"\n]*[>\"])")],
    "ruby": [("class", r"^[ \t]*class\s+(?P<name>[\p{Lu}][\w:]*)(?:\s*<\s*(?P<sup>[\w:]+))?"), ("module", r"^[ \t]*module\s+(?P<name>[\p{Lu}][\w:]*)"), ("method", r"^[ \t]*def\s+(?:self\.)?(?P<name>[\p{L}_]\w*[?!=]?)\s*(?P<params>\([^)]*\))?"), ("constant", r"^[ \t]*(?P<name>\p{Lu}[\p{Lu}\d_]+)\s*="), ("import", r"^[ \t]*require(?:_relative)?\s*\(?\s*(?P<name>[\"'][^\"']*[\"'])")],
    "php": [("namespace", r"^[ \t]*namespace\s+(?P<name>[\w\\]+)"), ("import", r"^use\s+(?P<name>[\w\\{}, ]+);"), ("class", rf"^[ \t]*{_MODS}class\s+(?P<name>{_ID})(?:\s+extends\s+(?P<sup>[\w\\]+))?"), ("interface", rf"^[ \t]*interface\s+(?P<name>{_ID})(?:\s+extends\s+(?P<sup>[^{{]+))?"), ("trait", rf"^[ \t]*trait\s+(?P<name>{_ID})"), ("enum", rf"^[ \t]*enum\s+(?P<name>{_ID})"),
            ("function", rf"^[ \t]*{_MODS}function\s+&?(?P<name>{_ID})\s*(?P<params>\([^)]*\))(?:\s*:\s*(?P<type>[\w\\?|]+))?"), ("property", rf"^[ \t]+{_MODS}(?:[\w\\?|]+\s+)?\$(?P<name>\w+)\s*(?:=[^;]*)?;"), ("constant", rf"^[ \t]*{_MODS}const\s+(?P<name>{_ID})")],
    "zig": [("function", rf"^[ \t]*(?:pub\s+)?(?:export\s+|inline\s+|extern\s+)*fn\s+(?P<name>{_ID})\s*(?P<params>\([^)]*\))\s*(?P<type>[^{{;]+)"), ("struct", rf"^[ \t]*(?:pub\s+)?const\s+(?P<name>{_ID})\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("enum", rf"^[ \t]*(?:pub\s+)?const\s+(?P<name>{_ID})\s*=\s*enum\b"), ("union", rf"^[ \t]*(?:pub\s+)?const\s+(?P<name>{_ID})\s*=\s*union\b"),
            ("import", rf"^[ \t]*(?:pub\s+)?const\s+\w+\s*=\s*@import\((?P<name>\"[^\"]*\")\)"), ("constant", rf"^[ \t]*(?:pub\s+)?const\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?!(?:packed\s+|extern\s+)?(?:struct|enum|union)\b|@import)"), ("variable", rf"^[ \t]*(?:pub\s+)?(?:threadlocal\s+)?var\s+(?P<name>{_ID})")],
    "elixir": [("module", r"^[ \t]*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^[ \t]*defp?\s+(?P<name>[\p{L}_]\w*[?!]?)\s*(?P<params>\([^)]*\))?"), ("function", r"^[ \t]*defmacrop?\s+(?P<name>[\p{L}_]\w*[?!]?)"), ("struct", r"^[ \t]*(?P<name>defstruct)\b"), ("interface", r"^[ \t]*defprotocol\s+(?P<name>[\w.]+)"), ("import", r"^[ \t]*(?:import|alias|use|require)\s+(?P<name>[\w.]+)"), ("type", r"^[ \t]*@typep?\s+(?P<name>\w+)")],
    "erlang": [("module", r"^-module\((?P<name>\w+)\)"), ("function", r"^(?P<name>[a-z]\w*)\s*(?P<params>\([^)]*\))\s*(?:when[^-]*)?->"), ("struct", r"^-record\(\s*(?P<name>\w+)"), ("constant", r"^-define\(\s*(?P<name>\w+)"), ("type", r"^-(?:type|opaque)\s+(?P<name>\w+)"), ("import", r"^-(?:include|include_lib|import)\(\s*(?P<name>[^,)]+)")],
    "fsharp": [("module", r"^[ \t]*(?:module|namespace)\s+(?:rec\s+)?(?P<name>[\w.]+)"), ("function", r"^[ \t]*let\s+(?:rec\s+|inline\s+|private\s+)*(?P<name>[\p{L}_]\w*)\s+(?P<params>[^=\n:]+?)(?:\s*:\s*(?P<type>[^=\n]+))?="), ("variable", r"^[ \t]*let\s+(?:mutable\s+)?(?P<name>[\p{L}_]\w*)\s*(?::[^=\n]+)?="), ("type", r"^[ \t]*type\s+(?P<name>\w+)"), ("method", r"^[ \t]*(?:static\s+)?(?:member|override|default)\s+(?:\w+\.)?(?P<name>\w+)"), ("import", r"^[ \t]*open\s+(?P<name>[\w.]+)")],
    "lua": [("function", r"^[ \t]*(?:local\s+)?function\s+(?P<name>[\w.:]+)\s*(?P<params>\([^)]*\))"), ("function", r"^[ \t]*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\s*(?P<params>\([^)]*\))"), ("variable", r"^[ \t]*local\s+(?P<name>\w+)\s*=\s*(?!function|require)"), ("import", r"^[ \t]*local\s+\w+\s*=\s*require\s*\(?\s*(?P<name>[\"'][^\"']*[\"'])")],
    "r": [("function", r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*(?P<params>\([^)]*\))"), ("variable", r"^(?P<name>[\w.]+)\s*<-\s*(?!function)"), ("import", r"^[ \t]*(?:library|require)\((?P<name>[\w.\"']+)\)")],
    "bash": [("function", r"^[ \t]*(?:function\s+)?(?P<name>[\w:.-]+)\s*\(\)\s*\{?"), ("function", r"^[ \t]*function\s+(?P<name>[\w:.-]+)\s*\{"), ("constant", r"^[ \t]*(?:readonly|declare\s+-r\w*|export)\s+(?P<name>\w+)="), ("variable", r"^(?P<name>[A-Za-z_]\w*)="), ("import", r"^[ \t]*(?:source|\.)\s+(?P<name>\S+)")],
    "powershell": [("function", r"(?i)^[ \t]*(?:function|filter)\s+(?:\w+:)?(?P<name>[\w-]+)\s*(?P<params>\([^)]*\))?"), ("class", r"(?i)^[ \t]*class\s+(?P<name>\w+)(?:\s*:\s*(?P<sup>[\w.]+))?"), ("enum", r"(?i)^[ \t]*enum\s+(?P<name>\w+)"), ("variable", r"^\$(?:\w+:)?(?P<name>\w+)\s*="), ("import", r"(?i)^[ \t]*(?:Import-Module|using\s+(?:module|namespace))\s+(?P<name>\S+)")],
    "gdscript": [("class", r"^(?:class_name|[ \t]*class)\s+(?P<name>\w+)(?:\s+extends\s+(?P<sup>\w+))?"), ("function", r"^[ \t]*(?:static\s+)?func\s+(?P<name>\w+)\s*(?P<params>\([^)]*\))(?:\s*->\s*(?P<type>\w+))?"), ("variable", r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:export\s+|onready\s+)?var\s+(?P<name>\w+)"), ("constant", r"^[ \t]*const\s+(?P<name>\w+)"), ("event", r"^[ \t]*signal\s+(?P<name>\w+)"), ("enum", r"^[ \t]*enum\s+(?P<name>\w+)"), ("import", r"^extends\s+(?P<name>\S+)")],
    "vbnet": [("namespace", r"(?i)^[ \t]*namespace\s+(?P<name>[\w.]+)"), ("class", r"(?i)^[ \t]*(?:(?:public|private|friend|partial|mustinherit|notinheritable|shared)\s+)*(?:class|module)\s+(?P<name>\w+)"), ("interface", r"(?i)^[ \t]*(?:(?:public|private|friend)\s+)*interface\s+(?P<name>\w+)"), ("struct", r"(?i)^[ \t]*(?:(?:public|private|friend)\s+)*structure\s+(?P<name>\w+)"), ("enum", r"(?i)^[ \t]*(?:(?:public|private|friend)\s+)*enum\s+(?P<name>\w+)"),
              ("method", r"(?i)^[ \t]*(?:(?:public|private|protected|friend|shared|overrides|overridable|async|mustoverride|overloads)\s+)*(?:sub|function)\s+(?P<name>\w+)\s*(?P<params>\([^)]*\))?(?:\s+as\s+(?P<type>[\w().]+))?"), ("property", r"(?i)^[ \t]*(?:(?:public|private|protected|friend|shared|readonly|writeonly|overrides)\s+)*property\s+(?P<name>\w+)"), ("event", r"(?i)^[ \t]*(?:public\s+)?event\s+(?P<name>\w+)"), ("import", r"(?i)^[ \t]*imports\s+(?P<name>[\w.]+)")],
    "qml": [("class", r"^[ \t]*(?:[\w.]+\s*:\s*)?(?P<name>\p{Lu}[\w.]*)\s*\{"), ("property", r"^[ \t]*(?:default\s+|readonly\s+|required\s+)*property\s+(?P<type>[\w<>.]+)\s+(?P<name>\w+)"), ("event", r"^[ \t]*signal\s+(?P<name>\w+)"), ("function", r"^[ \t]*function\s+(?P<name>\w+)\s*(?P<params>\([^)]*\))"), ("import", r"^import\s+(?P<name>[\w.\"'/]+)")],
    "qmldir": [("module", r"^module\s+(?P<name>\S+)"), ("class", r"^(?:singleton\s+|internal\s+)?(?P<name>\p{Lu}\w*)\s+(?:\d+\.\d+\s+)?\S+\.qml"), ("import", r"^(?:import|depends)\s+(?P<name>\S+)")],
    "gomod": [("module", r"^module\s+(?P<name>\S+)"), ("import", r"^\s*(?:require\s+)?(?P<name>[\w./-]+\.[\w./-]+)\s+v\S+")],
    "css": [("class", r"^[ \t]*(?P<name>[.#]?[\w-][^{}@;\n]*?)\s*\{"), ("variable", r"^[ \t]*(?P<name>--[\w-]+)\s*:"), ("function", r"^[ \t]*@(?:keyframes|mixin)\s+(?P<name>[\w-]+)"), ("import", r"^[ \t]*@import\s+(?P<name>[^;]+);")],
    "sql": [(k, rf"(?i)^[ \t]*create\s+(?:or\s+(?:replace|alter)\s+)?(?:temp(?:orary)?\s+|unlogged\s+|materialized\s+|unique\s+|clustered\s+)*{w}\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`\[\]]+)")
            for k, w in (("class", "table"), ("class", "view"), ("function", "function"), ("function", "procedure"), ("function", "trigger"), ("type", "type"), ("property", "index"), ("variable", "sequence"), ("namespace", "schema"), ("type", "domain"))],
    "toml": [("module", r"^[ \t]*\[{1,2}\s*(?P<name>[^\]\n]+?)\s*\]{1,2}"), ("property", r"^[ \t]*(?P<name>[\w.\"'-]+)\s*=")],
    "yaml": [("property", r"^[ \t]*(?:-\s+)?(?P<name>[\w.$/\"'-]+)\s*:(?=\s|$)")],
    "json": [("property", r"(?P<name>\"(?:[^\"\\\n]|\\.)*\")\s*:")],
    "markdown": [("module", r"^ {0,3}#{1,6}[ \t]+(?P<name>[^\n]+?)[ \t\r#]*$")],
    "xml": [("class", r"<(?P<name>[A-Za-z_][\w:.-]*)(?:\s[^<>]*)?/?>")],
    "html": [("class", r"<(?P<name>[A-Za-z][\w-]*)(?:\s[^<>]*)?>")],
    "regex": [("variable", r"\(\?P?<(?P<name>[A-Za-z_]\w*)>")],
    "gosum": [],
}
for _l in ("javascript", "typescript", "tsx", "jsx", "vue"):
    DECLARATIONS[_l] = _script()
DECLARATIONS["cpp"] = [
    *DECLARATIONS["c"], ("class", rf"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(?:\w+\s+)?(?P<name>{_ID})(?:\s+final)?(?:\s*:\s*(?P<sup>[^{{;]+))?\s*\{{"), ("namespace", r"^[ \t]*(?:inline\s+)?namespace\s+(?P<name>[\w:]+)"),
    ("method", rf"^(?:[\w:<>&*,\s]+\s+)?(?P<sup>\w+)::(?P<name>~?{_ID})\s*(?P<params>\([^;{{)]*\))[^;{{]*\{{"),
]
DECLARATIONS["razor"] = [*DECLARATIONS["csharp"], ("import", r"^@using\s+(?P<name>[\w.]+)")]
DECLARATIONS["python"] = [
    ("class", r"^[ \t]*class\s+(?P<name>\w+)(?:\((?P<sup>[^)]*)\))?"), ("function", r"^[ \t]*(?:async\s+)?def\s+(?P<name>\w+)\s*(?P<params>\([^)]*\))(?:\s*->\s*(?P<type>[^:\n]+))?"),
    ("constant", r"^(?P<name>\p{Lu}[\p{Lu}\d_]+)\s*(?::[^=\n]+)?="), ("variable", r"^(?P<name>[\p{L}_]\w*)\s*(?::[^=\n]+)?=(?!=)"),
    ("import", r"^[ \t]*(?:from\s+(?P<name>[\w.]+)\s+import|import\s+(?P<name>[\w., ]+))"),
]
#: What decides and what loops, for complexity.
DECISIONS = r"\b(?:if|elif|elsif|elseif|unless|case|when|catch|except|rescue|guard)\b|&&|\|\||\?(?![.?:])|\b(?:and|or)\b"
LOOPS = r"\b(?:for|foreach|while|until|loop|repeat)\b"
KEYWORDS = frozenset(
    "if else elif elsif unless case when switch match for foreach while until loop repeat do end return break continue class struct enum interface trait impl fn func def "
    "function var let const val pub public private protected static final abstract import from package use using namespace module new delete try catch except finally raise throw "
    "throws in is as and or not null nil None true false True False self this super async await yield with lambda type void int string bool float double char byte long short".split()
)
CALLABLE = ("function", "method", "constructor", "destructor", "operator")
