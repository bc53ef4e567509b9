"""Structural facts: each pattern is an expression over a file's text; its named groups become the fact's metadata.

``on`` says which text it sees: code (comments and string contents blank), bare (comments blank) or raw. Families
that follow a rule (verb routes, directives of a manifest, elements of a document) are built from the rule.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex


class Pattern(NamedTuple):
    id: str
    languages: tuple[str, ...]
    family: str
    on: str
    expression: str
    node: str = "statement"


JS = ("javascript", "jsx", "typescript", "tsx")
_S = r"(?P<q>[\"'`])(?P<path>[^\"'`\n]*)(?P=q)"
_VERB = r"(?P<verb>get|post|put|patch|delete|head|options|all|any)"
# The ids of the patterns, their languages and families; the expressions are this engine's own.
PATTERNS: list[Pattern] = []


def _add(id_: str, languages: str | tuple[str, ...], family: str, on: str, expression: str, node: str = "statement") -> None:
    langs = tuple(languages.split()) if isinstance(languages, str) else languages
    PATTERNS.append(Pattern(f"{id_}.v1", langs, family, on, expression, node))


def _rows(language: str, family: str, on: str, *rows: tuple[str, str]) -> None:
    for name, expression in rows:
        _add(f"{language}.{name}", language, family, on, expression)


# ---- frameworks: receiver.verb("path", handler)
for _f, _langs, _recv in (
    ("express", JS, r"(?:app|router|api|server)"), ("koa", ("javascript", "typescript"), r"(?:router)"), ("fastify", JS, r"(?:fastify)"),
    ("lapis", ("lua",), r"app"), ("ktor", ("kotlin",), None), ("vapor", ("swift",), r"(?:app|routes|group)"), ("sinatra", ("ruby",), None),
    ("httpz", ("zig",), r"router"), ("shelf_router", ("dart",), r"(?:router|app)"),
):
    _head = rf"\b(?P<receiver>{_recv})[.:]" if _recv else r"(?m)^[ \t]*"
    _add(f"{_f}.route", _langs, "framework", "bare", rf"{_head}{_VERB}\s*\(?\s*{_S}", "call_expression")
for _f in ("gin", "echo", "fiber", "chi"):
    _add(f"{_f}.route", "go", "framework", "bare", rf"\b(?P<receiver>\w+)\.(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any|Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*{_S}\s*,", "call_expression")
for _f, _langs, _x in (
    ("go.net_http.route", "go", rf"\b(?:http|mux|\w+)\.Handle(?:Func)?\(\s*{_S}"), ("gorilla_mux.route", "go", rf"\.HandleFunc\(\s*{_S}[^\n]*\)\.Methods\((?P<methods>[^)]*)\)"),
    ("chi.mount", "go", rf"\.Mount\(\s*{_S}"), ("express.router_mount", JS, rf"\b(?:app|router)\.use\(\s*{_S}\s*,"), ("hapi.route", "javascript typescript", rf"server\.route\(\s*\{{[^}}]*path\s*:\s*{_S}"),
    ("nestjs.route", "javascript typescript", rf"@(?P<verb>Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*(?:{_S})?\s*\)"), ("nextjs.route_handler", "javascript typescript", r"(?m)^export\s+(?:async\s+)?function\s+(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"),
    ("nextjs.route_reference", JS, rf"<Link\b[^>]*\bhref=\{{?{_S}|\brouter\.(?P<verb>push|replace|prefetch)\(\s*[\"'](?P<to>[^\"']*)"), ("react.route_definition", JS, rf"<Route\b[^>]*\bpath=\{{?{_S}"), ("react.route_reference", JS, rf"<(?:Link|NavLink)\b[^>]*\bto=\{{?{_S}|\bnavigate\(\s*[\"'](?P<to>[^\"']*)"),
    ("vue.route_definition", ("vue", *JS), rf"\{{\s*path\s*:\s*{_S}\s*,[^}}]*\bcomponent\b"), ("vue.route_reference", "vue", rf"<router-link\b[^>]*\bto={_S}|\$router\.(?P<verb>push|replace)\(\s*[\"'](?P<to>[^\"']*)"), ("nuxt.route_reference", "vue", rf"<NuxtLink\b[^>]*\bto={_S}"),
    ("angular.route_definition", "typescript", rf"\{{\s*path\s*:\s*{_S}\s*,[^}}]*(?:component|loadChildren|redirectTo)\b"), ("nuxt.server_route", "javascript typescript", r"export\s+default\s+(?P<handler>defineEventHandler|eventHandler)\("),
    ("flask.route", "python", rf"@(?P<receiver>\w+)\.route\(\s*{_S}"), ("flask.blueprint_registration", "python", r"\.register_blueprint\(\s*(?P<blueprint>\w+)"), ("fastapi.route", "python", rf"@(?P<receiver>\w+)\.{_VERB}\(\s*{_S}"), ("fastapi.include_router", "python", r"\.include_router\(\s*(?P<router>[\w.]+)"),
    ("django.url_pattern", "python", rf"\b(?:path|re_path|url)\(\s*r?{_S}\s*,"), ("django.url_include", "python", rf"\b(?:path|re_path|url)\(\s*r?{_S}\s*,\s*include\("), ("drf.api_view", "python", r"@api_view\(\s*(?P<methods>\[[^\]]*\])?"), ("drf.router_registration", "python", rf"\.register\(\s*r?{_S}\s*,\s*(?P<viewset>\w+)"), ("drf.viewset_action", "python", r"@action\((?P<args>[^)]*)\)"),
    ("actix.attribute_route", "rust", rf"#\[(?P<verb>get|post|put|patch|delete|head|options|route)\(\s*\"(?P<path>/?[^\"]*)\""), ("rocket.route", "rust", r"#\[(?P<verb>get|post|put|patch|delete|head|options|route)\(\s*\"(?P<path>/[^\"]*)\"[^\]]*\)\]\s*(?:pub\s+)?(?:async\s+)?fn"), ("rocket.mount", "rust", r"\.mount\(\s*\"(?P<path>[^\"]*)\"\s*,\s*routes!\[(?P<handlers>[^\]]*)\]"),
    ("axum.route", "rust", r"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<verb>get|post|put|patch|delete|any)\("), ("axum.nest", "rust", r"\.nest\(\s*\"(?P<path>[^\"]*)\""), ("actix.scope_route", "rust", r"web::scope\(\s*\"(?P<path>[^\"]*)\"\s*\)"), ("actix.resource_route", "rust", r"web::resource\(\s*\"(?P<path>[^\"]*)\"\s*\)"), ("actix.mount", "rust", r"web::scope\(\s*\"(?P<path>[^\"]*)\"\s*\)\s*\.(?P<how>configure|service)\("),
    ("spring.request_mapping", "java kotlin", r"@(?P<verb>Get|Post|Put|Patch|Delete|Request)Mapping(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?(?:\{?\s*\"(?P<path>[^\"]*)\")?)?"), ("spring.functional_route", "kotlin", r"\b(?P<verb>GET|POST|PUT|PATCH|DELETE)\(\s*\"(?P<path>[^\"]*)\""), ("jaxrs.route", "java", r"@(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Path)\b(?:\(\s*\"(?P<path>[^\"]*)\")?"),
    ("aspnet.attribute_route", "csharp fsharp vbnet", r"[\[<]\s*(?P<verb>Route|RoutePrefix|Http(?:Get|Post|Put|Patch|Delete|Head|Options))(?:\(\s*\"(?P<path>[^\"]*)\")?"), ("aspnet.minimal_api.route", "csharp fsharp razor vbnet", r"\.Map(?P<verb>Get|Post|Put|Patch|Delete|Methods)\(\s*\"(?P<path>[^\"]*)\""), ("aspnet.minimal_api.route_group", "csharp razor vbnet", r"\.MapGroup\(\s*\"(?P<path>[^\"]*)\""),
    ("aspnet.conventional_route", "csharp vbnet", r"\.Map(?:Area|Default)?ControllerRoute\((?P<args>[^)]*)\)"), ("efcore.db_set", "csharp", r"\bDbSet<(?P<entity>\w+)>\s+(?P<name>\w+)"), ("efcore.entity_configuration", "csharp", r"IEntityTypeConfiguration<(?P<entity>\w+)>"), ("efcore.table_mapping", "csharp", r"(?:\.ToTable\(|\[Table\()\s*\"(?P<table>[^\"]*)\""),
    ("rails.route", "ruby", rf"(?m)^[ \t]*(?P<verb>get|post|put|patch|delete|match|root)\s+{_S}\s*(?:,|=>)"), ("rails.resource_route", "ruby", r"(?m)^[ \t]*(?P<kind>resources|resource)\s+:(?P<name>\w+)"), ("rails.mount", "ruby", r"(?m)^[ \t]*mount\s+(?P<app>[\w:]+)\s*(?:=>|,\s*at:)\s*[\"'](?P<path>[^\"']*)"), ("sinatra.filter", "ruby", rf"(?m)^[ \t]*(?P<when>before|after)\s+{_S}\s+do"),
    ("laravel.route", "php", rf"Route::{_VERB}\(\s*{_S}"), ("laravel.resource_route", "php", rf"Route::(?P<kind>resource|apiResource)\(\s*{_S}"), ("laravel.route_prefix", "php", rf"Route::prefix\(\s*{_S}"), ("symfony.route", "php", rf"#\[Route\(\s*(?:path:\s*)?{_S}"),
    ("phoenix.route", "elixir", rf"(?m)^[ \t]*{_VERB}\s+{_S}\s*,\s*(?P<controller>[\w.]+)\s*,\s*:(?P<action>\w+)"), ("phoenix.resource_route", "elixir", rf"(?m)^[ \t]*resources\s+{_S}\s*,\s*(?P<controller>[\w.]+)"), ("phoenix.forward", "elixir", rf"(?m)^[ \t]*forward\s+{_S}\s*,\s*(?P<plug>[\w.]+)"), ("phoenix.socket", "elixir", rf"(?m)^[ \t]*socket\s+{_S}\s*,\s*(?P<module>[\w.]+)"), ("phoenix.channel", "elixir", rf"(?m)^[ \t]*channel\s+{_S}\s*,\s*(?P<module>[\w.]+)"),
    ("akka_http.route", "scala", rf"\bpath(?:Prefix)?\(\s*{_S}\s*\)\s*\{{\s*(?P<verb>get|post|put|patch|delete)\b"), ("http4s.route", "scala", r"case\s+(?P<verb>GET|POST|PUT|PATCH|DELETE)\s*->\s*(?P<path>Root(?:\s*/\s*[^=\n]+?)?)\s*=>"), ("giraffe.route", "fsharp", r"\b(?P<kind>route|routef|routeStartsWith|subRoute|routeCi|routeCif|subRouteCi)\s+\"(?P<path>[^\"]*)\""), ("cowboy.route", "erlang", r"\{\s*\"(?P<path>/[^\"]*)\"\s*,\s*(?P<handler>\w+)\s*,"),
    ("plumber.route", "r", r"(?m)^#\*\s*@(?P<verb>get|post|put|delete|head|options|patch)\s+(?P<path>\S+)"), ("go_router.route_definition", "dart", rf"GoRoute\(\s*path\s*:\s*{_S}"), ("go_router.route_reference", "dart", rf"\.(?P<verb>go|push|replace|pushReplacement|goNamed|pushNamed)\(\s*{_S}"),
    ("http.client_request", (*JS, "vue", "html", "python", "csharp", "razor", "kotlin", "php", "rust", "elixir", "go"), rf"\b(?:(?P<client>fetch|axios|requests|httpx|Http|client|reqwest)(?:::|\.)?(?P<verb>get|post|put|patch|delete|head|GetAsync|PostAsync|Get|Post)?)\(\s*{_S}"),
    ("alpine.directive", "html razor", r"\s(?P<name>x-[\w:.-]+|@[\w.:-]+|:[\w-]+)=\"(?P<value>[^\"]*)\""), ("htmx.attribute", ("html", "razor", "vue", *JS), r"\s(?P<name>(?:data-)?hx-[\w:-]+)=\"(?P<value>[^\"]*)\""),
):
    _add(_f, _langs, "framework", "raw" if _f == "plumber.route" else "bare", _x, "call_expression")

# ---- language constructs
_rows("bash", "shell", "code", ("arithmetic_expansion", r"\$\(\((?P<expr>[^()]*)\)\)"), ("command_substitution", r"\$\((?!\()|`[^`\n]*`"), ("export_declaration", r"(?m)^[ \t]*(?:export|(?:declare|local)\s+-\w*x\w*)\s+(?P<names>[\w= ]+)"))
_add("bash.shebang", "bash", "script_header", "raw", r"\A#![^\n]*")
for _l in ("c", "cpp"):
    _add(f"{_l}.preprocessor_definition", _l, "preprocessor", "code", r"(?m)^[ \t]*#\s*define\s+(?P<name>\w+)(?P<params>\([^)]*\))?")
_add("cpp.qt_property", "cpp", "properties", "code", r"Q_PROPERTY\(\s*(?P<type>[\w:<>*]+)\s+(?P<name>\w+)(?P<rest>[^)]*)\)")
for _l in ("javascript", "jsx", "typescript", "tsx", "dart", "swift"):
    _add(f"{_l}.await_expression", _l, "async", "code", r"\bawait\b")
_rows("dart", "async", "code", ("async_modifier", r"\)\s*(?P<kind>async\*?|sync\*)"), ("annotation", r"(?m)^[ \t]*@(?P<name>[\w.]+)"))
_rows("elixir", "module", "code", ("defmodule_call", r"\bdefmodule\s+(?P<name>[\w.]+)"), ("directive_call", r"(?m)^[ \t]*(?P<kind>use|import|alias|require)\s+(?P<module>[\w.]+)"), ("module_attribute", r"(?m)^[ \t]*@(?P<name>[a-z]\w*)"), ("pipeline_operator", r"\|>"), ("with_expression", r"\bwith\s+\S[^\n]*<-"))
_rows("erlang", "module", "bare", ("behaviour_declaration", r"(?m)^-behaviou?r\((?P<name>\w+)\)"), ("callback_declaration", r"(?m)^-callback\s+(?P<name>\w+)"), ("export_attribute", r"(?m)^-(?P<kind>export|export_type)\(\[(?P<names>[^\]]*)\]"), ("include_directive", r"(?m)^-(?P<kind>include|include_lib)\(\"(?P<path>[^\"]*)\""), ("module_attribute", r"(?m)^-module\((?P<name>\w+)\)"))
_rows("fsharp", "fsharp", "code", ("active_pattern", r"\(\|(?P<names>[^)]*)\|\)"), ("attribute", r"\[<(?P<name>[\w.]+)"), ("computation_expression", r"\b(?P<builder>task|async|seq|result|option|query)\s*\{"), ("quotation", r"<@@?"))
_rows("gdscript", "godot", "bare", ("class_name", r"(?m)^class_name\s+(?P<name>\w+)"), ("export_annotation", r"(?m)^[ \t]*(?:@export\w*|export)\b[^\n]*?var\s+(?P<name>\w+)"), ("extends_declaration", r"(?m)^extends\s+(?P<base>\S+)"), ("match_statement", r"(?m)^[ \t]*match\s+[^\n:]+:"), ("signal_declaration", r"(?m)^[ \t]*signal\s+(?P<name>\w+)"))
_rows("godot", "godot", "bare", ("node_path", r"(?:\$|%)(?P<path>[\w/]+)|get_node\(\s*\"(?P<node>[^\"]*)\""), ("resource_reference", r"\b(?:pre)?load\(\s*\"(?P<path>res://[^\"]*)\""), ("rpc_annotation", r"@rpc\b"), ("signal_connection", r"(?P<signal>\w+)\.connect\(\s*(?P<handler>[\w.]+)"), ("signal_emission", r"(?P<signal>\w+)\.emit\(|emit_signal\(\s*\"(?P<name>\w+)\""))
PATTERNS[-5:] = [p._replace(languages=("gdscript",)) for p in PATTERNS[-5:]]
_rows("go", "concurrency", "code", ("defer_statement", r"\bdefer\s+(?P<call>[\w.]+)\("), ("goroutine_launch", r"(?m)^[ \t]*go\s+(?P<call>[\w.]+)\("))
_rows("java", "java", "code", ("annotation", r"@(?P<name>(?!interface)\w+)\("), ("marker_annotation", r"@(?P<name>(?!interface)\w+)(?![\w(.])"), ("lambda_expression", r"->"), ("synchronized_statement", r"\bsynchronized\s*\("), ("try_with_resources_statement", r"\btry\s*\("), ("module_directive", r"(?m)^[ \t]*(?P<kind>requires|exports|opens|uses|provides)\s+(?P<name>[\w. ]+);"))
_add("javascript.qml_directive", "javascript", "qml", "raw", r"(?m)^\.(?P<kind>pragma|import)\s+(?P<rest>[^\n]+)")
_rows("kotlin", "kotlin", "code", ("annotation", r"@(?P<name>\w+)"), ("property_delegate", r"\bva[lr]\s+(?P<name>\w+)[^=\n]*\bby\s+(?P<delegate>\w+)"), ("suspend_modifier", r"\bsuspend\s+fun\s+(?P<name>\w+)"))
_rows("kotest", "testing", "code", ("property_check", r"\b(?P<kind>checkAll|forAll|forNone)\s*[({<]"), ("table_check", r"\b(?P<kind>forAll|forNone)\s*\(\s*(?:table|row)\b"))
PATTERNS[-2:] = [p._replace(languages=("kotlin",)) for p in PATTERNS[-2:]]
_rows("lua", "lua", "bare", ("coroutine_call", r"\bcoroutine\.(?P<name>\w+)\("), ("module_return", r"(?m)^return\s+(?P<name>\w+)\s*\Z"), ("require_call", r"\brequire\s*\(?\s*[\"'](?P<module>[^\"']*)"), ("setmetatable_call", r"\bsetmetatable\("), ("table_constructor", r"=\s*\{"))
for _f, _x in (("love.callback", r"(?:function\s+love\.(?P<name>\w+)|love\.(?P<n2>\w+)\s*=\s*function)"), ("neovim.autocmd", r"nvim_create_autocmd\(\s*(?P<events>\{[^}]*\}|\"[^\"]*\")"), ("neovim.keymap", r"(?:vim\.keymap\.set|nvim_(?:buf_)?set_keymap)\((?P<args>[^)\n]*)"), ("neovim.user_command", r"nvim_(?:buf_)?create_user_command\(\s*\"(?P<name>[^\"]*)\""), ("lazy_nvim.plugin_spec", r"(?m)^\s*\{?\s*\"(?P<plugin>[\w.-]+/[\w.-]+)\"")):
    _add(_f, "lua", "framework", "bare", _x)
_rows("php", "php", "code", ("anonymous_function", r"\bfunction\s*\(|\bfn\s*\("), ("attribute", r"#\[(?P<name>[\w\\]+)"), ("include_call", r"\b(?P<kind>include|include_once|require|require_once)\b"), ("match_expression", r"\bmatch\s*\("), ("namespace_definition", r"(?m)^namespace\s+(?P<name>[\w\\]+)"), ("namespace_use_declaration", r"(?m)^use\s+(?P<name>[\w\\]+)"), ("trait_use_declaration", r"(?m)^[ \t]+use\s+(?P<name>[\w\\]+)\s*[;,{]"))
_rows("powershell", "powershell", "code", ("class_definition", r"(?im)^[ \t]*class\s+(?P<name>\w+)"), ("cmdlet_binding_attribute", r"(?i)\[CmdletBinding\("), ("param_block", r"(?i)\bparam\s*\("), ("pipeline_expression", r"\|(?!\|)"), ("data_key", r"(?m)^[ \t]*(?P<key>\w+)\s*="), ("module_manifest", r"(?m)^[ \t]*(?P<key>RootModule|ModuleVersion)\s*="), ("dsc_resource", r"(?m)^[ \t]+(?P<type>\p{Lu}\w+)\s+(?P<name>\w+)\s*\{"))
_add("python.decorated_definition", "python", "decorators", "code", r"(?m)^[ \t]*@(?P<decorator>[\w.]+)[^\n]*\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)")
_rows("qml", "qml", "bare", ("binding", r"(?m)^[ \t]*(?P<name>[a-z][\w.]*)\s*:\s*(?P<value>[^\n{]+)"), ("component_url", r"[\"'](?P<url>[^\"'\n]*\.qml)[\"']"), ("import_statement", r"(?m)^import\s+(?P<module>\S+)(?:\s+(?P<version>[\d.]+))?"), ("object_instantiation", r"(?m)^[ \t]*(?:\w+\s*:\s*)?(?P<type>\p{Lu}[\w.]*)\s*\{"), ("pragma", r"(?m)^pragma\s+(?P<name>\w+)"), ("property_declaration", r"\bproperty\s+(?P<type>[\w<>.]+)\s+(?P<name>\w+)"), ("signal_declaration", r"(?m)^[ \t]*signal\s+(?P<name>\w+)"), ("typeinfo_declaration", r"(?m)^[ \t]*(?P<kind>Module|Component|Method|Signal|Property|Enum)\s*\{"))
for _n, _x in (("module", r"module\s+(?P<name>\S+)"), ("singleton_type", r"singleton\s+(?P<name>\w+)"), ("internal_type", r"internal\s+(?P<name>\w+)"), ("object_type", r"(?P<name>\p{Lu}\w*)\s+[\d.]+\s+(?P<file>\S+\.qml)"), ("javascript_resource", r"(?P<name>\w+)\s+[\d.]+\s+(?P<file>\S+\.m?js)"), ("system", "system"), ("static", "static"), ("designer_supported", "designersupported"), *((k, rf"(?:optional\s+|default\s+)*{k}\s+(?P<value>\S[^\n]*)") for k in ("classname", "depends", "import", "linktarget", "plugin", "prefer", "typeinfo"))):
    _add(f"qmldir.{_n}", "qmldir", "manifest", "code", rf"(?m)^{_x}[ \t]*(?=\s|$)")
for _n in ("module", "go", "toolchain", "godebug", "exclude", "ignore", "replace", "retract", "tool"):
    _add(f"gomod.{_n}", "gomod", "manifest", "code", rf"(?m)^{_n}\s+(?P<value>[^\n(]+)")
_add("gosum.checksum", "gosum", "manifest", "raw", r"(?m)^(?P<module>\S+)\s+(?P<version>v[^\s/]+)(?P<gomod>/go\.mod)?\s+(?P<hash>h1:\S+)$")
_rows("r", "r", "code", ("formula_expression", r"(?P<left>[\w.]+)?\s*~\s*(?P<right>[\w.+*:| ]+)"), ("library_call", r"\b(?P<call>library|require|requireNamespace|p_load)\(\s*[\"']?(?P<package>[\w.]*)"), ("namespace_directive", r"(?m)^(?P<kind>export|exportPattern|exportClasses|exportMethods|import|importFrom|S3method|useDynLib)\("), ("pipe_expression", r"\|>|%>%|%<>%|%T>%|%\$%"))
for _n, _x in (("app", r"\bshinyApp\("), ("input", r"\b(?P<widget>\w+Input|actionButton|actionLink|radioButtons)\(\s*[\"'](?P<id>[^\"']*)"), ("module", r"\b(?P<call>moduleServer|callModule)\("), ("output", r"\b(?P<widget>\w+Output)\(\s*[\"'](?P<id>[^\"']*)|output\$(?P<name>\w+)\s*<-"), ("reactive", r"\b(?P<kind>reactive|eventReactive|reactiveVal|reactiveValues|observe|observeEvent)\(")):
    _add(f"shiny.{_n}", "r", "framework", "bare", _x)
_rows("razor", "razor", "bare", ("code_block", r"@(?P<kind>code|functions)\s*\{"), ("layout_reference", r"@layout\s+(?P<name>\S+)|Layout\s*=\s*\"(?P<path>[^\"]*)"), ("model_binding", r"@model\s+(?P<type>[\w.<>]+)|asp-for=\"(?P<for>[^\"]*)"), ("mvc_link", r"asp-(?:controller|action)=\"(?P<value>[^\"]*)"), ("page_directive", r"(?m)^@page(?:\s+\"(?P<path>[^\"]*)\")?"), ("partial_reference", r"<partial\b[^>]*name=\"(?P<name>[^\"]*)|Html\.Partial(?:Async)?\(\"(?P<n2>[^\"]*)"), ("template_expression", r"@(?:\((?P<expr>[^)]*)\)|(?P<name>[A-Za-z_][\w.]*))"), ("view_component_reference", r"Component\.InvokeAsync\(\"(?P<name>[^\"]*)|<vc:(?P<tag>[\w-]+)"))
_add("razor.route_reference", "csharp razor", "framework", "bare", r"NavigateTo\(\s*\"(?P<path>[^\"]*)|<(?:a|NavLink)\b[^>]*href=\"(?P<href>/[^\"]*)")
_add("blazor.component_reference", "razor", "component_reference", "bare", r"<(?P<name>\p{Lu}\w*)\b")
for _n, _x in (("alternation", r"(?<!\\)\|"), ("anchor", r"\\[bBAzZG]|(?<!\[)\^|\$(?=$|\)|\|)"), ("backreference", r"\\[1-9]|\\k<(?P<name>\w+)>|\(\?P=(?P<n2>\w+)\)"), ("branch_reset", r"\(\?\|"), ("capture_group", r"(?<!\\)\((?!\?)"), ("character_class", r"(?<!\\)\[(?P<body>\^?\]?[^\]]*)\]"), ("conditional", r"\(\?\((?P<cond>[^)]*)\)"), ("inline_flags", r"\(\?(?P<flags>[imsxuU-]+)[:)]"), ("lookaround", r"\(\?<?[=!]"), ("named_capture", r"\(\?P?<(?P<name>[A-Za-z_]\w*)>"), ("quantifier", r"(?<!\\)(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?"), ("quoted_literal", r"\\Q(?P<text>[\s\S]*?)\\E")):
    _add(f"regex.{_n}", "regex", "pattern", "raw", _x)
_rows("ruby", "ruby", "bare", ("block", r"\bdo\b(?:\s*\|(?P<params>[^|]*)\|)?|\{\s*\|(?P<p2>[^|]*)\|"), ("mixin_call", r"(?m)^[ \t]*(?P<kind>include|extend|prepend)\s+(?P<module>[\w:]+)"), ("require_call", r"\brequire(?:_relative)?\s*\(?\s*[\"'](?P<path>[^\"']*)"), ("rescue_clause", r"\brescue\b(?:\s+(?P<type>[\w:]+))?"))
_rows("rust", "rust", "code", ("benchmark", r"#\[bench\]|\bcriterion_group!\("), ("unsafe_block", r"\bunsafe\s*\{"))
_add("rust.doc_test", "rust", "testing", "raw", r"(?m)(?:^[ \t]*///?!?[ \t]*```(?:rust)?[ \t]*\n)(?P<body>(?:^[ \t]*//[/!][^\n]*\n)*?)^[ \t]*//[/!][ \t]*```")
_rows("scala", "scala", "code", ("annotation", r"@(?P<name>\w+)"), ("extension_definition", r"(?m)^[ \t]*extension\b"), ("for_expression", r"\bfor\s*[({]"), ("given_definition", r"(?m)^[ \t]*given\b(?:\s+(?P<name>\w+))?"))
_rows("swift", "swift", "code", ("actor_declaration", r"\bactor\s+(?P<name>\w+)"), ("attribute", r"@(?P<name>\w+)"))
_add("swift_testing.trait", "swift", "testing", "bare", r"@(?P<on>Test|Suite)\((?P<traits>[^)]*)\)")
for _n, _x in (("package", r"\bPackage\(\s*name:\s*\"(?P<name>[^\"]*)"), ("product", r"\.(?P<kind>library|executable|plugin)\(\s*name:\s*\"(?P<name>[^\"]*)"), ("target", r"\.(?P<kind>target|testTarget|executableTarget|macro|plugin|systemLibrary|binaryTarget)\(\s*name:\s*\"(?P<name>[^\"]*)")):
    _add(f"swiftpm.{_n}", "swift", "manifest", "bare", _x)
_rows("vbnet", "vbnet", "code", ("attribute", r"(?m)^[ \t]*<(?P<name>\w+)"), ("event_declaration", r"(?im)^[ \t]*(?:public\s+)?event\s+(?P<name>\w+)"), ("handles_clause", r"(?i)\bHandles\s+(?P<events>[\w., ]+)"), ("implements_clause", r"(?i)\bImplements\s+(?P<names>[\w., ]+)"))
_rows("zig", "zig", "bare", ("build_artifact", r"\bb\.(?P<kind>addExecutable|addLibrary|addStaticLibrary|addSharedLibrary|addTest|addObject)\("), ("build_dependency", r"\bb\.dependency\(\s*\"(?P<name>[^\"]*)"), ("build_module", r"\bb\.(?:addModule\(\s*\"(?P<name>[^\"]*)|createModule\()"), ("build_module_import", r"\.addImport\(\s*\"(?P<name>[^\"]*)"), ("build_step", r"\bb\.step\(\s*\"(?P<name>[^\"]*)"), ("builtin_call", r"@(?P<name>[a-z]\w*)\("), ("comptime_parameter", r"\bcomptime\s+(?P<name>\w+)\s*:"), ("exported_function", r"\bexport\s+fn\s+(?P<name>\w+)"), ("inline_function", r"\binline\s+fn\s+(?P<name>\w+)"), ("threadlocal_variable", r"\bthreadlocal\s+var\s+(?P<name>\w+)"))

# ---- documents: markup, style, data, SQL
for _n, _tags, _need in (("link", "a", r"\bhref="), ("area_link", "area", r"\bhref="), ("resource_link", "link", r"\bhref="), ("embed", "iframe|embed|object", ""), ("form", "form", ""), ("form_control", "input|button|select|textarea", ""), ("landmark", "main|nav|header|footer|aside|section|article", ""), ("media", "img|source|audio|video|track", r"\bsrc="), ("script", "script", "")):
    _attr = {"href": r"(?=[^>]*\bhref=[\"']?(?P<href>[^\"'\s>]*))", "src": r"(?=[^>]*\bsrc=[\"']?(?P<src>[^\"'\s>]*))"}
    _look = _attr["href"] if "href" in _need else _attr["src"] if "src" in _need else r"(?:(?=[^>]*\b(?:src|action|name|type)=[\"']?(?P<value>[^\"'\s>]*)))?"
    _add(f"html.{_n}", "html", "document", "bare", rf"(?i)<(?P<tag>{_tags})\b{_look}[^>]*>", "element")
_add("html.data_attribute", "html", "document", "bare", r"\s(?P<name>data-(?!hx-)[\w-]+)(?:=\"(?P<value>[^\"]*)\")?", "attribute")
for _n, _rule in (("charset", "charset"), ("container", "container"), ("font_face", "font-face"), ("import", "import"), ("keyframes", "(?:-webkit-)?keyframes"), ("layer", "layer"), ("media_query", "media"), ("namespace", "namespace"), ("scope", "scope"), ("supports", "supports"), ("tailwind_apply", "apply"), ("tailwind_directive", "(?:tailwind|utility|theme|plugin|config|source|variant|custom-variant)")):
    _add(f"css.{_n}", "css vue html", "stylesheet", "bare", rf"@{_rule}\b\s*(?P<prelude>[^;{{]*)", "at_rule")
_add("css.custom_property", "css vue html", "stylesheet", "bare", r"(?m)(?<![\w-])(?P<name>--[\w-]+)\s*:\s*(?P<value>[^;}]+)")
_add("css.selector_rule", "css vue html", "stylesheet", "bare", r"(?m)^[ \t]*(?P<selector>[^{}@;/\n][^{}@;\n]*?)\s*\{(?!\{)")
_add("vue.sfc_section", "vue", "component", "bare", r"(?m)^<(?P<section>template|script|style)\b(?P<attrs>[^>]*)>")
_add("vue.template_directive", "vue", "component", "bare", r"\s(?P<name>v-[\w:.-]+|@[\w.:-]+|:[\w.-]+)=\"(?P<value>[^\"]*)\"")
_rows("markdown", "markdown", "raw", ("autolink", r"<(?P<target>https?://[^>\s]+|[\w.+-]+@[\w.-]+)>"), ("definition_list_item", r"(?m)^(?P<term>\S[^\n]*)\n:[ \t]+(?P<definition>[^\n]+)"), ("fenced_code_block", r"(?ms)^ {0,3}(?P<fence>```+|~~~+)[ \t]*(?P<info>[^\n`]*)\n.*?^ {0,3}(?P=fence)[ \t]*$"), ("footnote_definition", r"(?m)^\[\^(?P<label>[^\]]+)\]:[ \t]*(?P<text>[^\n]*)"), ("footnote_reference", r"\[\^(?P<label>[^\]]+)\](?!:)"), ("frontmatter", r"\A(?P<mark>---|\+\+\+)\n(?P<body>[\s\S]*?)\n(?P=mark)(?=\n|\Z)"), ("heading", r"(?m)^ {0,3}(?P<level>#{1,6})[ \t]+(?P<title>[^\n]+?)[ \t#]*$|^(?P<setext>\S[^\n]*)\n(?:=+|-+)[ \t]*$"), ("inline_link", r"(?<!!)\[(?P<label>[^\]\[]*)\]\((?P<target>[^()\s]+)[^)]*\)"), ("link_definition", r"(?m)^ {0,3}\[(?P<label>[^\]^][^\]]*)\]:[ \t]*(?P<target>\S+)"), ("reference_link", r"\[(?P<text>[^\]\[]+)\]\[(?P<label>[^\]]*)\]"), ("table", r"(?m)^\|[^\n]*\|[ \t]*\n\|[ :|-]+\|[ \t]*$"), ("task_list_item", r"(?m)^[ \t]*[-*+][ \t]+\[(?P<state>[ xX])\][ \t]+(?P<text>[^\n]*)"))
_rows("json", "data", "bare", ("array", r"\["), ("object", r"\{"), ("property", r"\"(?P<key>(?:[^\"\\\n]|\\.)*)\"\s*:"), ("ref", r"\"\$ref\"\s*:\s*\"(?P<target>[^\"]*)"), ("schema", r"\"\$schema\"\s*:\s*\"(?P<uri>[^\"]*)"), ("schema_definition", r"\"(?:\$defs|definitions|schemas)\"\s*:\s*\{\s*\"(?P<name>[^\"]*)"))
_add("openapi.route", "json yaml", "framework", "bare", r"(?m)(?:^[ \t]+|\")(?P<path>/[\w/{}.-]*)\"?\s*:\s*\{?\s*\"?(?P<verb>get|post|put|patch|delete|head|options)\"?\s*:")
_add("manifest.dependency", "json toml xml swift erlang gomod", "manifest", "bare", r"(?m)^[ \t]*\"?(?P<name>[@\w./-]+)\"?\s*[:=]\s*\"(?P<version>[~^>=<]*\d[\w.*+-]*)\"|<PackageReference\s+Include=\"(?P<package>[^\"]*)\"|^\s*(?:require\s+)?(?P<module>[\w.-]+\.[\w./-]+)\s+(?P<v>v\d\S*)|\.package\(\s*url:\s*\"(?P<url>[^\"]*)")
_add("manifest.script", "json", "manifest", "bare", r"(?<=\"scripts\")\s*:\s*\{\s*\"(?P<name>[^\"]*)\"\s*:\s*\"(?P<command>[^\"]*)")
_rows("toml", "data", "bare", ("array_table", r"(?m)^[ \t]*\[\[\s*(?P<name>[^\]\n]+?)\s*\]\]"), ("inline_table", r"=\s*\{"), ("key_value", r"(?m)^[ \t]*(?P<key>[\w.\"'-]+)\s*="), ("table", r"(?m)^[ \t]*\[(?!\[)\s*(?P<name>[^\]\n]+?)\s*\]"))
_rows("yaml", "data", "bare", ("alias", r"(?<=[\s\[,])\*(?P<name>[\w-]+)"), ("anchor", r"(?<=[\s\[,])&(?P<name>[\w-]+)"), ("document", r"(?m)\A(?!---)\S|^---"), ("key_value", r"(?m)^[ \t]*(?:-[ \t]+)?(?P<key>[\w.$/\"'-]+)\s*:(?=\s|$)"), ("mapping", r"(?m)^[ \t]*[\w.-]+:[ \t]*\n[ \t]+[\w.-]+:|\{"), ("sequence", r"(?m)^[ \t]*-[ \t]+\S|\["), ("ref", r"\$ref\s*:\s*[\"']?(?P<target>[^\s\"']+)"), ("ci_uses", r"(?m)^[ \t]*-?[ \t]*uses:[ \t]*(?P<action>\S+)"), ("ci_job", r"(?m)^  (?P<name>[\w-]+):[ \t]*\n(?:    [^\n]*\n)*?    (?:runs-on|script|steps|stage):"), ("ci_trigger", r"(?m)^on:[ \t]*(?P<events>\[[^\]]*\]|\w+)?"), ("compose_service", r"(?m)^services:[ \t]*\n(?:[ \t]*\n)*  (?P<name>[\w-]+):"), ("k8s_resource", r"(?m)^apiVersion:[ \t]*(?P<version>\S+)[\s\S]*?^kind:[ \t]*(?P<kind>\S+)"), ("ansible_task", r"(?m)^[ \t]*-[ \t]+name:[ \t]*(?P<name>[^\n]+)"))
_rows("xml", "xml", "bare", ("document", r"\A\s*(?:<\?xml[^>]*\?>\s*)?(?:<!DOCTYPE[^>]*>\s*)?<(?P<root>[\w:.-]+)"), ("document_link", r"<\?xml-(?:stylesheet|model)[^>]*href=\"(?P<href>[^\"]*)|<!DOCTYPE\s+\w+\s+SYSTEM\s+\"(?P<system>[^\"]*)"), ("namespace_declaration", r"\sxmlns(?::(?P<prefix>[\w-]+))?=\"(?P<uri>[^\"]*)\""), ("config_entry", r"<add\s+key=\"(?P<key>[^\"]*)\"\s+value=\"(?P<value>[^\"]*)"), ("msbuild_property", r"(?s)<PropertyGroup[^>]*>\s*<(?P<name>\w+)>(?P<value>[^<]*)"), ("mybatis_statement", r"<(?P<kind>select|insert|update|delete|sql)\s+id=\"(?P<id>[^\"]*)"), ("servlet_route", r"<url-pattern>(?P<path>[^<]*)"), ("spring_bean", r"<bean\b[^>]*class=\"(?P<class>[^\"]*)"), ("spring_component_scan", r"<context:component-scan[^>]*base-package=\"(?P<package>[^\"]*)"), ("test_selection", r"<class\s+name=\"(?P<name>[^\"]*)"), ("android_permission", r"<(?:uses-)?permission[^>]*android:name=\"(?P<name>[^\"]*)"), ("android_component", r"<(?P<kind>application|activity|activity-alias|service|receiver|provider)\b[^>]*android:name=\"(?P<name>[^\"]*)"))
for _n in ("binding", "message", "operation", "port", "service"):
    _add(f"xml.wsdl.{_n}", "xml", "wsdl", "bare", rf"<(?:wsdl:)?{_n}\s+name=\"(?P<name>[^\"]*)")
for _n, _x in (("element", r"element\s+name=\"(?P<name>[^\"]*)"), ("import", r"(?:import|include)\b[^>]*schemaLocation=\"(?P<location>[^\"]*)"), ("schema", r"schema\b"), ("type", r"(?P<kind>complexType|simpleType)\s+name=\"(?P<name>[^\"]*)")):
    _add(f"xml.xsd.{_n}", "xml", "xsd", "bare", rf"<(?:xsd?:){_x}")
_NAME = r"(?P<name>[\w.\"`\[\]]+)"
for _n in ("table", "view", "index", "sequence", "function", "procedure", "trigger", "type", "role", "policy"):
    _add(f"sql.{_n}_definition", "sql", "sql", "code", rf"(?i)\bcreate\s+(?:or\s+(?:replace|alter)\s+)?(?:temp(?:orary)?\s+|materialized\s+|unique\s+|clustered\s+|nonclustered\s+)*{_n}\s+(?:if\s+not\s+exists\s+)?{_NAME}")
for _n, _x in (("column_definition", r"(?im)^[ \t]+(?P<name>[\w\"`\[\]]+)[ \t]+(?P<type>(?:big|small|tiny)?int(?:eger)?|serial|bigserial|text|(?:n?var)?char(?:acter)?[^,\n]*?|numeric[^,\n]*?|decimal[^,\n]*?|real|double[^,\n]*?|bool(?:ean)?|date(?:time\d?)?|timestamp\w*|uuid|jsonb?|bytea|blob|float)\b"), ("constraint", r"(?i)\b(?P<kind>primary\s+key|unique|check|not\s+null|foreign\s+key|constraint\s+\w+)\b"), ("cte", r"(?i)\bwith\s+(?:recursive\s+)?(?P<name>\w+)\s+as\b"), ("delete_statement", rf"(?i)\bdelete\s+from\s+{_NAME}"), ("extension", r"(?i)\bcreate\s+extension\s+(?:if\s+not\s+exists\s+)?\"?(?P<name>[\w-]+)"), ("foreign_key", rf"(?i)\breferences\s+{_NAME}"), ("insert_statement", rf"(?i)\binsert\s+into\s+{_NAME}"), ("join", rf"(?i)\b(?P<kind>(?:left|right|full|inner|cross)?\s*(?:outer\s+)?join)\s+{_NAME}"), ("merge_statement", rf"(?i)\bmerge\s+(?:into\s+)?{_NAME}"), ("select_query", r"(?i)\bselect\b"), ("transaction", r"(?i)(?:^|;)\s*(?P<kind>begin|commit|rollback|savepoint|start\s+transaction)\b"), ("update_statement", rf"(?i)\bupdate\s+{_NAME}\s+set\b"), ("window_definition", r"(?i)\bover\s*\(|\bwindow\s+\w+\s+as\b")):
    _add(f"sql.{_n}", "sql", "sql", "code", _x)
# ---- facts of a path
FILE_ROUTES = (
    ("nextjs.file_route.v1", JS, r"^(?:.*/)?(?:src/)?(?:app/(?P<app>.*?)/?page|pages/(?P<pages>(?!api/|_).*?))\.(?:jsx?|tsx?)$"),
    ("nuxt.file_route.v1", ("vue", *JS), r"^(?:.*/)?pages/(?P<pages>.*?)\.(?:vue|jsx?|tsx?)$"),
)
# The marker words.
MARKER = r"^(?P<marker>TODO|FIXME|HACK|XXX|RAZORBACK)(?:\((?P<owner>[^)]*)\))?(?=[:\s-]|$)[:\s-]*(?P<text>.*)$"


@lru_cache(None)
def for_language(language: str) -> tuple[tuple[Pattern, regex.Pattern], ...]:
    """The patterns of a language, compiled once per worker."""
    return tuple((p, regex.compile(p.expression)) for p in PATTERNS if language in p.languages)
