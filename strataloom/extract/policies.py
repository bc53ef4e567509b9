"""Which string literals of calls and configuration are kept, and as what: URLs, SQL or routes by their carrier.

A policy is a parameter: ``POLICIES`` holds those of common languages, ``load`` reads others from a folder of TOML files
(``<language>.toml`` with a table ``literal_carriers`` of url, sql, route, exclude and retain_unclassified).
"""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple


class Policy(NamedTuple):
    url: frozenset[str] = frozenset()
    sql: frozenset[str] = frozenset()
    route: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()
    keep_all: bool = False  # literals without a known carrier are kept as ``other``


def policy(url: str = "", sql: str = "", route: str = "", exclude: str = "", keep_all: bool = False) -> Policy:
    return Policy(*(frozenset(x.lower().split()) for x in (url, sql, route, exclude)), keep_all)


# The carriers of each language.
_SCRIPT = policy(
    "fetch $fetch axios axios.get axios.post axios.put axios.delete axios.patch axios.request axios.head request ky ky.get ky.post ky.put ky.delete ky.patch ky.head "
    "got got.get got.post got.put got.delete got.patch ofetch",
    "query execute exec raw prepare $queryraw $executeraw $queryrawunsafe $executerawunsafe",
)
_CONFIG = policy("url uri href homepage repository documentation website endpoint base_url base-url baseurl api_url api-url apiurl", keep_all=True)
_KEPT = policy(keep_all=True)
POLICIES: dict[str, Policy] = {
    "bash": policy("curl wget http https", "psql mysql mariadb sqlite3"),
    "c": policy("curl_easy_setopt", "sqlite3_exec sqlite3_prepare sqlite3_prepare_v2 sqlite3_prepare_v3 pqexec pqprepare pqexecparams mysql_query mysql_real_query"),
    "css": policy("url"),
    "gdscript": policy("request request_raw", "query query_with_bindings"),
    "go": policy(
        "http.get http.post http.head http.postform http.newrequest http.newrequestwithcontext",
        "query querycontext queryrow queryrowcontext exec execcontext prepare preparecontext queryx queryrowx namedexec namedquery mustexec",
    ),
    "gomod": _KEPT,
    "java": policy(
        "getForObject getForEntity postForObject postForEntity patchForObject exchange HttpRequest.newBuilder url URI.create",
        "execute executeQuery executeUpdate executeLargeUpdate prepareStatement prepareCall query queryForObject queryForList queryForMap update batchUpdate createQuery createNativeQuery Query",
    ),
    "javascript": _SCRIPT,
    "json": _CONFIG,
    "jsx": _SCRIPT,
    "lua": policy(
        "http.request https.request requests.get requests.post requests.put requests.delete requests.patch requests.head", "execute exec prepare query",
    ),
    "markdown": _KEPT,
    "powershell": policy("invoke-restmethod invoke-webrequest irm iwr", "invoke-sqlcmd invoke-sqlcmd2"),
    "python": policy(
        "requests.get requests.post requests.put requests.delete requests.patch requests.head requests.options requests.request httpx.get httpx.post httpx.put httpx.delete httpx.patch "
        "httpx.head httpx.options httpx.request urlopen urlretrieve",
        "execute executemany executescript text raw",
    ),
    "qml": policy("open openurlexternally", "executesql"),
    "regex": _KEPT,
    "rust": policy("reqwest.get reqwest.post reqwest.head ureq.get ureq.post", "query query_as query_scalar execute prepare query_row query_map batch_execute"),
    "sql": policy(sql="exec execute sp_executesql", keep_all=True),
    "swift": policy("url af.request", "prepare run execute scalar"),
    "toml": _CONFIG,
    "tsx": _SCRIPT,
    "typescript": _SCRIPT,
    "vue": _SCRIPT,
    "xml": policy("url href src schemalocation", keep_all=True),
    "yaml": _CONFIG,
    "zig": policy("std.uri.parse std.uri.parseafterscheme", "exec prepare"),
}


def load(folder: str) -> dict[str, Policy]:
    """The built-in policies with those of a folder in their place."""
    import tomllib

    out = dict(POLICIES)
    for p in sorted(Path(folder).glob("*.toml")):
        c = tomllib.loads(p.read_text("utf-8")).get("literal_carriers", {})
        lists = (frozenset(x.lower() for x in c.get(k, [])) for k in ("url", "sql", "route", "exclude"))
        out[p.stem] = Policy(*lists, bool(c.get("retain_unclassified", False)))
    return out


def _among(known: frozenset[str], carrier: str) -> bool:
    return carrier in known or carrier.rpartition(".")[2] in known


def classify(p: Policy | None, carrier: str | None) -> str | None:
    """The kind of a literal with this carrier: url, sql, route or other; None where it is not kept.

    An excluded receiver and method (``receiver.method``, at the carrier's end) outweighs a match.
    """
    if p is None:
        return None
    rest = "other" if p.keep_all else None
    if carrier is None:
        return rest
    low = carrier.lower()
    if p.exclude and ".".join(low.replace("->", ".").replace("$", "").split(".")[-2:]) in p.exclude:
        return rest
    return "url" if _among(p.url, low) else "sql" if _among(p.sql, low) else "route" if _among(p.route, low) else rest
