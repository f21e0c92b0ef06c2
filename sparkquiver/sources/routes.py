"""Line scanners for HTTP routes that a file serves and HTTP calls that it makes."""

from __future__ import annotations

import re
from dataclasses import dataclass

METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "any", "all")
RECEIVERS = {"app": "express", "router": "express", "server": "express", "fastify": "fastify", "r": "gin", "e": "echo", "fiber": "fiber", "mux": "chi", "bp": "flask", "api": "flask"}
_QUOTED = r"""["'`]([^"'`]*)["'`]"""
_DOT = re.compile(rf"""\b([A-Za-z_]\w*)\.({"|".join(METHODS)})\(\s*{_QUOTED}(?:\s*,\s*(?:[^,()]*,\s*)*([A-Za-z_][\w.]*)\s*\)?)?""", re.I)
_DECORATED = re.compile(rf"@([A-Za-z_]\w*)\.({'|'.join(METHODS)}|route)\(\s*{_QUOTED}(.*)", re.I)
_HANDLE = re.compile(rf"http\.Handle(?:Func)?\(\s*{_QUOTED}\s*(?:,\s*([A-Za-z_][\w.]*))?")
_ATTRIBUTE = re.compile(rf"""#\[(get|post|put|delete|patch|head|options|route)\(\s*{_QUOTED}(?:.*?method\s*=\s*{_QUOTED})?[^\]]*\](.*)""", re.I)
_DEF = re.compile(r"\b(?:async\s+)?(?:def|fn)\s+([A-Za-z_]\w*)")


@dataclass(frozen=True)
class Route:
    method: str
    path: str
    framework: str
    line: int
    handler: str | None = None


def detect_routes(source: str) -> list[Route]:
    """One route a line at most, by the first form that fits; equal ones on a line count once."""
    out, lines = [], source.split("\n")

    def next_name(n: int) -> str | None:
        for text in lines[n : n + 4]:
            if m := _DEF.search(text):
                return m[1]
        return None

    for n, raw in enumerate(lines, 1):
        text = raw.strip()
        found = None
        if text.startswith("@"):
            if m := re.match(r"@api_view\(\s*\[\s*" + _QUOTED, text):
                found = Route(m[1].upper(), "/", "drf", n, next_name(n))
            elif m := re.match(rf"@api_route\(\s*{_QUOTED}.*?methods\s*=\s*\[\s*{_QUOTED}", text):
                found = Route(m[2].upper(), m[1], "fastapi", n, next_name(n))
            elif m := _DECORATED.match(text):
                named = re.search(r"methods\s*=\s*\[\s*" + _QUOTED, m[4])
                method = (named[1] if named else "GET") if m[2].lower() == "route" else m[2]
                found = Route(method.upper(), m[3], {"app": "fastapi", "router": "fastapi"}.get(m[1], RECEIVERS.get(m[1], "node_http")), n, next_name(n))
        elif m := _ATTRIBUTE.search(text):
            method = (m[3] or "*") if m[1].lower() == "route" else m[1]
            same = _DEF.search(m[4] or "")
            found = Route(method.upper(), m[2], "actix", n, same[1] if same else next_name(n))
        elif m := _HANDLE.search(text):
            found = Route("*", m[1], "net_http", n, m[2])
        elif (m := _DOT.search(text)) and m[1].lower() not in ("axios", "requests", "httpx", "client", "http", "reqwest"):
            found = Route(m[2].upper(), m[3], RECEIVERS.get(m[1], "node_http"), n, m[4])
        if found and found not in out:
            out.append(found)
    return out


_CALLS = [
    (re.compile(rf"(?:await\s+)?fetch\(\s*{_QUOTED}", re.I), lambda m: ("GET", m[1], "fetch")),
    (re.compile(rf"axios\.({'|'.join(METHODS)})\(\s*{_QUOTED}", re.I), lambda m: (m[1].upper(), m[2], "axios")),
    (re.compile(rf"axios\(\s*\{{.*?method\s*:\s*{_QUOTED}.*?url\s*:\s*{_QUOTED}", re.I), lambda m: (m[1].upper(), m[2], "axios")),
    (re.compile(rf"(requests|httpx|client)\.({'|'.join(METHODS)})\(\s*{_QUOTED}", re.I), lambda m: (m[2].upper(), m[3], m[1].lower())),
    (re.compile(rf"http\.(Get|PostForm|Post|Head)\(\s*(?:{_QUOTED})?", re.I), lambda m: (m[1].upper().replace("FORM", ""), m[2] or "<unknown>", "net_http")),
    (re.compile(rf"reqwest::(?:Client::)?({'|'.join(METHODS)})\(\s*{_QUOTED}", re.I), lambda m: (m[1].upper(), m[2], "reqwest")),
    (re.compile(rf"\$(http|axios)\.({'|'.join(METHODS)})\(\s*{_QUOTED}", re.I), lambda m: (m[2].upper(), m[3], "vue_http" if m[1].lower() == "http" else "axios")),
]


def detect_calls(source: str) -> list[Route]:
    """Calls that begin a trimmed line."""
    out = []
    for n, raw in enumerate(source.split("\n"), 1):
        for rx, make in _CALLS:
            if m := rx.match(raw.strip()):
                out.append(Route(*make(m), n))
                break
    return out
