"""A token scanner for source files: definitions, calls, imports, heritage, metrics and routes.

No grammar library is assumed; braces and keywords carry the structure. It reads Rust, TypeScript, JavaScript, C and C++.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from sparkquiver.sources.routes import detect_calls, detect_routes

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<pre>^[ \t]*\#[^\n]*)|(?P<str>b?r?"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n]){2,}'(?!\w))|(?P<float>\d+\.\d+\w*)|(?P<int>\d\w*)"""
    r"""|(?P<word>[A-Za-z_$][\w$]*)|(?P<op>=>|->|::|&&|\|\||\?\?|==|!=|<=|>=|\+=|-=|\*=|/=|\+\+|--|\.\.|[^\w\s])""",
    re.S | re.M,
)
_FAMILY = {"rust": "rust", "typescript": "ts", "javascript": "ts", "c": "c", "cpp": "c"}
_BRANCH = {"rust": {"if", "?"}, "ts": {"if", "case", "try", "?"}, "c": {"if", "case"}}
_LOOP = {"rust": {"for", "while", "loop"}, "ts": {"for", "while", "do"}, "c": {"for", "while", "do"}}
_BOOL = {"rust": {"&&", "||"}, "ts": {"&&", "||", "??"}, "c": {"&&", "||"}}
_ALLOC = {"rust": ("vec!", "Vec::new", "Box::new", "String::from", ".collect(", "HashMap::new", "BTreeMap::new", "Vec::with_capacity"), "ts": ("new ", ".map(", ".filter(", ".fromEntries(", ".concat(", ".push(", ".slice("), "c": ("malloc(", "calloc(", "realloc(", "new ")}
_SCAN = {"rust": (".find(", ".contains(", ".indexOf(", ".binary_search(", ".includes("), "ts": (".find(", ".findIndex(", ".includes(", ".indexOf(", ".some(", ".every("), "c": ("strstr(", "memchr(", ".find(", ".contains(")}
_DEFS = {"rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type_alias", "const": "constant", "static": "variable"}, "ts": {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum"}, "c": {"struct": "struct", "enum": "enum", "union": "type_alias", "class": "class"}}
_NOT_CALLS = frozenset("if for while switch match return fn function catch sizeof loop else do new await typeof in of let const var impl pub async unsafe move where as use super".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int
    at: int


@dataclass
class Parsed:
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)


def scan(source: str) -> list[Token]:
    out, line, at = [], 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            at += 1
            continue
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup or "op", m[0], line, at))
        line += m[0].count("\n")
        at = m.end()
    return out


def _close(tokens: list[Token], at: int) -> int:
    """Index of the brace that closes the one at `at`, or the last token."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].text == "{":
            depth += 1
        elif tokens[i].text == "}":
            depth -= 1
            if depth == 0:
                return i
    return len(tokens) - 1


def _end_of(tokens: list[Token], i: int) -> int:
    """Last token of the item whose name is at i: its block's brace or its semicolon."""
    depth = 0
    for j in range(i, len(tokens)):
        t = tokens[j].text
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if depth == 0 and t == "{":
            return _close(tokens, j)
        if depth == 0 and t == ";":
            return j
    return len(tokens) - 1


def _definitions(tokens: list[Token], family: str) -> list[tuple[str, int, int]]:
    """(kind, index of the name, index of the end)."""
    out = []
    for i, t in enumerate(tokens):
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        prev = tokens[i - 1].text if i else ""
        if t.kind != "word":
            continue
        if t.text in _DEFS[family] and nxt is not None and nxt.kind == "word" and prev != "." and nxt.text not in ("fn", "async"):
            if family == "c" and not (i + 2 < len(tokens) and tokens[i + 2].text in ("{", ":", "final")):
                continue
            if t.text == "const" and nxt.text in ("unsafe", "extern"):
                continue
            out.append((_DEFS[family][t.text], i + 1, _end_of(tokens, i + 1)))
        elif family == "ts" and t.text in ("const", "let", "var") and nxt is not None and nxt.kind == "word":
            j = i + 2
            if j < len(tokens) and tokens[j].text == "=":
                stop = next((k for k in range(j, min(len(tokens), j + 400)) if tokens[k].text in ("=>", ";", "{")), None)
                if stop is not None and tokens[stop].text == "=>":
                    out.append(("function", i + 1, _end_of(tokens, stop)))
        elif nxt is not None and nxt.text == "(" and t.text not in _NOT_CALLS:
            stop = _paren(tokens, i + 1)
            body = stop + 1
            if family == "ts":
                if body < len(tokens) and tokens[body].text == ":":
                    body = next((k for k in range(body, min(len(tokens), body + 40)) if tokens[k].text in ("{", ";")), body)
                if body < len(tokens) and tokens[body].text == "{" and prev not in ("function", ".", "=", "(", ",", "new", "return") and prev in ("{", "}", ";", "async", "static", "public", "private", "protected", "get", "set", "readonly", "override"):
                    out.append(("method", i, _close(tokens, body)))
            elif family == "c" and body < len(tokens) and tokens[body].text in ("{", "const") and prev not in (".", "->", "=", "(", ",", "return", "&&", "||", "!"):
                body = body if tokens[body].text == "{" else body + 1
                if body < len(tokens) and tokens[body].text == "{":
                    out.append(("function", i, _close(tokens, body)))
    return out


def _paren(tokens: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i].text == "(") - (tokens[i].text == ")")
        if depth == 0:
            return i
    return len(tokens) - 1


def _declared(tokens: list[Token], found: list[tuple[str, int, int]]) -> set[int]:
    """Indexes of constructor and destructor names that a C++ class only declares: its own name before a parenthesis, in its body."""
    out = set()
    for kind, name, end in found:
        if kind not in ("class", "struct"):
            continue
        depth = 0
        for i in range(name + 1, end):
            depth += (tokens[i].text == "{") - (tokens[i].text == "}")
            if depth == 1 and tokens[i].text == tokens[name].text and tokens[i + 1].text == "(" and tokens[i - 1].text not in ("=", "return", "(", ",", "new"):
                out.add(i)
    return out


def _calls(tokens: list[Token], family: str, names: set[int]) -> list[tuple[str, int]]:
    out = []
    for i in range(len(tokens) - 1):
        t = tokens[i]
        if t.kind == "word" and tokens[i + 1].text == "(" and t.text not in _NOT_CALLS and i not in names and not (family == "rust" and i and tokens[i - 1].text == "::"):
            out.append((t.text, t.line))
    return out


def metrics(source: str, tokens: list[Token], name: str, family: str) -> dict[str, str]:
    """Complexity of a definition's tokens, as the text values that nodes carry."""
    cyclomatic, cognitive, deepest, depth = 1, 0, 0, 0
    blocks: list[str] = []  # what each open brace belongs to
    pending = ""
    alloc = linear = recursive = False
    first_call, ifs = 0, []
    start_line = tokens[0].line if tokens else 1
    for i, t in enumerate(tokens):
        loops = blocks.count("loop")
        if t.text in _LOOP[family] and t.kind == "word":
            # `while` that ends a do-while isn't another loop.
            if not (t.text == "while" and i and tokens[i - 1].text == "}" and family != "rust" and blocks[-1:] == ["done"]):
                cyclomatic += 1
                cognitive += 1 + depth
                deepest = max(deepest, loops + 1)
                pending = "loop"
        elif t.text in _BRANCH[family] and (t.kind == "word" or t.text == "?"):
            cyclomatic += 1
            cognitive += 1 + depth
            pending = "branch" if t.kind == "word" and t.text != "case" else pending
            if t.text == "if":
                ifs.append(i)
        elif family == "rust" and t.text == "=>" and "match" in blocks:
            cyclomatic += 1
            cognitive += 1 + depth
        elif t.text == "match" and family == "rust":
            pending = "match"
        elif t.text in _BOOL[family]:
            cyclomatic += 1
            cognitive += 1 + depth
        elif t.text == "{":
            blocks.append(pending or "block")
            depth += pending in ("loop", "branch")
            pending = ""
        elif t.text == "}" and blocks:
            depth -= blocks.pop() in ("loop", "branch")
        if loops and t.kind in ("word", "op"):
            here = source[max(0, t.at - 1) : t.at + 24]
            alloc = alloc or any(here[1:].startswith(a) or here.startswith(a) for a in _ALLOC[family])
            linear = linear or any(here.startswith(a) for a in _SCAN[family])
        if i and t.text == name and i + 1 < len(tokens) and tokens[i + 1].text == "(" and not recursive and t.line >= start_line:
            recursive, first_call = True, i
    guarded = False
    for i in ifs:
        if i < first_call or tokens[i].line <= tokens[first_call].line:
            body = next((k for k in range(i, len(tokens)) if tokens[k].text == "{"), None)
            end = _close(tokens, body) if body is not None else i
            other = end + 1 < len(tokens) and tokens[end + 1].text == "else"
            guarded = guarded or other or (tokens[end].line <= tokens[first_call].line and any(x.text == "return" for x in tokens[i:end]))
    flag = lambda b: "true" if b else "false"
    return {"cyclomatic": str(cyclomatic), "cognitive": str(cognitive), "loop_depth": str(deepest), "alloc_in_loop": flag(alloc), "linear_scan_in_loop": flag(linear), "recursion": flag(recursive), "unguarded_recursion": flag(recursive and not guarded)}


def ast_profile(tokens: list[Token], family: str) -> list[float]:
    """25 counters of control flow, nesting, operators, operands and lines."""
    n = dict.fromkeys(range(25), 0.0)
    levels, depth, operators, operands = [], 0, [], []
    for i, t in enumerate(tokens):
        nxt = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if t.text == "{":
            depth += 1
            levels.append(depth)
        elif t.text == "}":
            depth = max(0, depth - 1)
        n[0] += t.text == "if"
        n[1] += t.text in ("match", "switch")
        n[2] += t.kind == "word" and t.text in _LOOP[family]
        n[3] += t.text in ("try", "?") and (t.text == "try" or family == "rust")
        n[8] += t.text in ("+", "-", "*", "/", "%", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "??")
        n[9] += t.text in ("!", "++", "--")
        n[10] += t.kind == "word" and nxt == "(" and t.text not in _NOT_CALLS
        n[11] += t.text in (".", "[")
        n[12] += t.kind == "int"
        n[13] += t.kind == "float"
        n[14] += t.kind == "str"
        n[15] += len(re.findall(r"[A-Za-z_]\w*", t.text)) if t.kind == "str" else 0
        n[16] += t.text in ("=", "+=", "-=", "*=", "/=")
        n[17] += t.text == "return"
        (operators if t.kind == "op" else operands).append(t.text)
    opened = next((i for i, t in enumerate(tokens) if t.text == "("), None)
    if opened is not None:
        stop = _paren(tokens, opened)
        params = {t.text for t in tokens[opened:stop] if t.kind == "word"}
        n[18] = sum(t.kind == "word" and t.text in params for t in tokens[stop:])
        inside = 0
        for t in tokens[stop + 1 :]:
            inside += (t.text == "(") - (t.text == ")")
            n[19] += inside > 0 and t.kind == "word"
    if levels:
        mean = sum(levels) / len(levels)
        n[4], n[5], n[6], n[7] = max(levels), mean, sum(levels), math.sqrt(sum((x - mean) ** 2 for x in levels) / len(levels))
    n[20], n[21], n[22] = len(operators), len(operands), len(set(operators)) + len(set(operands))
    n[23], n[24] = n[20] + n[21], (tokens[-1].line - tokens[0].line + 1) if tokens else 0
    return [float(n[i]) for i in range(25)]


def _modifiers(line_text: str, family: str) -> dict:
    pub = re.search(r"\bpub(\([^)]*\))?\s", line_text)
    exported = bool(pub and not pub[1]) if family == "rust" else bool(re.search(r"\bexport\b", line_text)) if family == "ts" else False
    visibility = ("pub" + (pub[1] or "") if pub else None) if family == "rust" else next((w for w in ("public", "private", "protected") if re.search(rf"\b{w}\b", line_text)), None)
    return {"is_exported": exported, "visibility": visibility, "is_async": bool(re.search(r"\basync\b", line_text)), "is_static": bool(re.search(r"\bstatic\b", line_text)), "is_abstract": bool(re.search(r"\babstract\b", line_text))}


#: Statements that import, over as many lines as they take; the module's name is the group.
_IMPORT = {
    "rust": re.compile(r"^[ \t]*(?:pub\s+)?use\s+(\w+)\s*;", re.M),
    "ts": re.compile(r"""^[ \t]*import\b(?:[^;'"()]*?\bfrom\b)?\s*['"]([^'"\n]+)['"]""", re.M),
    "c": re.compile(r"""^[ \t]*\#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]""", re.M),
}
#: (what inherits, from what) of a heritage clause.
_HERITAGE = {
    "rust": re.compile(r"^[ \t]*(?:unsafe\s+)?impl\s*(?:<[^>{]*>)?\s*([\w:]+)(?:<[^>{]*>)?\s+for\s+(\w+)", re.M),
    "ts": re.compile(r"\bclass\s+(\w+)(?:<[^>{]*>)?\s+extends\s+([\w.]+)"),
    "c": re.compile(r"\b(?:class|struct)\s+(\w+)(?:\s+final)?\s*:\s*((?:[\w:<>,\s]|::)+?)\s*\{"),
}


def _heritage(source: str, family: str) -> list[tuple[str, str, str, int]]:
    """(source id, target, kind, line) of what inherits or implements."""
    out = []
    for m in _HERITAGE[family].finditer(source):
        line = source.count("\n", 0, m.start(1)) + 1
        if family == "rust":
            out.append((f"struct:{m[2]}", f"trait:{m[1].rpartition('::')[2]}:*", "implements", line))
        elif family == "ts":
            out.append((f"class:{m[1]}", f"class:{m[2].rpartition('.')[2]}:*", "extends", line))
        else:
            for base in re.sub(r"<[^<>]*>", "", m[2]).split(","):
                words = [w for w in re.split(r"[\s:]+", base) if w and w not in ("public", "private", "protected", "virtual")]
                if words:
                    out.append((f"class:{m[1]}", f"class:{words[-1]}:*", "extends", line))
    return out


def parse_file(path: str, source: str, language: str, unique_ids: bool = False) -> Parsed:
    """Nodes and edges of one file; calls, imports and heritage aim at names, which resolve_references turns into nodes.

    A node's id is its kind, name and line, which two files may share; with unique_ids the path follows.
    """
    family, out = _FAMILY[language], Parsed()
    tokens, lines = scan(source), source.split("\n")
    file_id = f"file:{path}"
    module = path.replace("/", "::").replace(".", "")
    out.nodes.append({"id": file_id, "kind": "file", "name": path.rpartition("/")[2], "qualified_name": path, "file_path": path, "language": language, "start_line": 0, "end_line": 0})

    here = f":{path}" if unique_ids else ""

    def edge(source_id: str, target: str, kind: str, line: int) -> None:
        out.edges.append({"id": f"{kind}:{path}:{line}:{source_id}:{target}:{len(out.edges)}", "source": source_id, "target": target, "kind": kind, "line": line, "col": 0})

    names, definitions = set(), _definitions(tokens, family)
    for kind, i, end in definitions:
        t = tokens[i]
        names.add(i)
        text = lines[t.line - 1]
        start = t.line
        is_test = family == "rust" and kind == "function" and any("#[test]" in x or "::test]" in x for x in lines[max(0, t.line - 4) : t.line - 1])
        node_id = f"{kind}:{t.text}:L{start}{here}"
        extra = metrics(source, tokens[i : end + 1], t.text, family)
        extra["ast_profile"] = " ".join(f"{x:.6f}" for x in ast_profile(tokens[i : end + 1], family))
        out.nodes.append({"id": node_id, "kind": "test" if is_test else kind, "name": t.text, "qualified_name": f"{module}::{t.text}", "file_path": path, "language": language, "start_line": start, "end_line": tokens[end].line, "signature": text.strip()[:120] or None, "extra": extra} | _modifiers(text.split("{")[0], family))
        edge(file_id, node_id, "contains", start)
    for name, line in _calls(tokens, family, names | (_declared(tokens, definitions) if family == "c" else set())):
        edge(file_id, f"function:{name}:*", "calls", line)
    for m in _IMPORT[family].finditer(source):
        n = source.count("\n", 0, m.start(1)) + 1
        node_id = f"import:{m[1]}:L{n}{here}"
        out.nodes.append({"id": node_id, "kind": "import", "name": m[1], "qualified_name": f"{module}::{m[1]}", "file_path": path, "language": language, "start_line": n, "end_line": n})
        edge(file_id, f"module:{m[1]}:*", "imports", n)
    for source_id, target, kind, n in _heritage(source, family):
        edge(source_id, target, kind, n)
    for r in detect_routes(source):
        node_id = f"route:server:{r.method}:{re.sub(r'[/:{}<>*? ]', '_', r.path)}:L{r.line}{here}"
        out.nodes.append({"id": node_id, "kind": "route", "name": r.path, "qualified_name": f"{module}::{r.path}", "file_path": path, "language": language, "start_line": r.line, "end_line": r.line, "extra": {"http.method": r.method, "http.path": r.path, "http.framework": r.framework, "http.role": "server"} | ({"http.handler": r.handler} if r.handler else {})})
        if r.handler:
            edge(node_id, f"function:{r.handler}:*", "route_handler", r.line)
    for c in detect_calls(source):
        node_id = f"route:client:{c.method}:{re.sub(r'[/:{}<>*? ]', '_', c.path)}:L{c.line}{here}"
        out.nodes.append({"id": node_id, "kind": "route", "name": c.path, "qualified_name": f"{module}::{c.path}", "file_path": path, "language": language, "start_line": c.line, "end_line": c.line, "extra": {"http.method": c.method, "http.path": c.path, "http.framework": c.framework, "http.role": "client"}})
        inner = [n for n in out.nodes if n["kind"] in ("function", "method", "constructor") and n["start_line"] <= c.line <= n["end_line"]]
        source_id = min(inner, key=lambda n: (n["end_line"] - n["start_line"], n["id"]))["id"] if inner else file_id
        edge(source_id, node_id, "http_calls", c.line)
    return out
