"""One text to the candidates it holds: a parser per format, plain Python, used by the frame operator.

Every parser takes (text, locator) and gives rows as dicts with the keys of FIELDS that apply; it raises
ValueError if the text is not of its format.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

FIELDS = [
    "candidate_type", "text", "locator", "line_start", "line_end", "heading_path", "key_path", "schema_path", "symbol_path",
    "endpoint_path", "signature_text", "language", "metadata",
]
#: Fixed value: methods of an interface description that are operations.
METHODS = ["delete", "get", "head", "options", "patch", "post", "put", "trace"]
Row = dict


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def _at(locator: str, start: int, end: int) -> dict:
    return {"locator": f"{locator}:L{start}-L{end}", "line_start": start, "line_end": end}


def paragraphs(text: str, locator: str) -> Iterator[Row]:
    """Runs of non-blank lines."""
    run: list[str] = []
    for n, line in enumerate([*_lines(text), ""], 1):
        if line.strip():
            run.append(line)
        elif run:
            yield {"candidate_type": "paragraph", "text": "\n".join(run), **_at(locator, n - len(run), n - 1)}
            run = []


class _Headings:
    """The path of open headings."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = []

    def push(self, level: int, title: str) -> list[str]:
        self.open = [x for x in self.open if x[0] < level] + [(level, title)]
        return self.path()

    def path(self) -> list[str]:
        return [t for _, t in self.open]


def anchor(title: str) -> str:
    return "-".join(title.lower().split())


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_LIST = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+")
_BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


def markdown(text: str, locator: str) -> Iterator[Row]:
    """Headings, paragraphs (as sections), fenced code and tables of a common subset of Markdown."""
    heads, lines, i = _Headings(), _lines(text), 0
    para: list[str] = []

    def flush(end: int) -> Iterator[Row]:
        nonlocal para
        if para:
            # lines count from 1, and ``end`` is the index of the line behind the paragraph
            yield {"candidate_type": "section", "text": "\n".join(x.strip() for x in para), "heading_path": heads.path(), **_at(locator, end - len(para) + 1, end)}
            para = []

    while i < len(lines):
        line = lines[i]
        fence, atx = _FENCE.match(line), _ATX.match(line)
        if fence:
            yield from flush(i)
            close = re.compile(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            j = next((j for j in range(i + 1, len(lines)) if close.match(lines[j])), len(lines))
            info = fence[2].split()
            body = "\n".join(lines[i + 1 : j])
            yield {
                "candidate_type": "code_block", "text": body + "\n" if body else "", "language": info[0] if info else None,
                "heading_path": heads.path(), **_at(locator, i + 1, min(j + 1, len(lines))),
            }
            i = j + 1
            continue
        if atx:
            yield from flush(i)
            title = (atx[2] or "").strip()
            yield {
                "candidate_type": "heading", "text": title, "heading_path": heads.push(len(atx[1]), title),
                "metadata": {"level": len(atx[1]), "anchor": anchor(title)}, **_at(locator, i + 1, i + 1),
            }
        elif para and re.match(r"^ {0,3}(=+|-+)[ \t]*$", line) and not _LIST.match(para[0]):
            level, title, start = (1 if "=" in line else 2), " ".join(x.strip() for x in para), i - len(para) + 1
            para = []
            yield {
                "candidate_type": "heading", "text": title, "heading_path": heads.push(level, title),
                "metadata": {"level": level, "anchor": anchor(title)}, **_at(locator, start, i + 1),
            }
        elif "|" in line and not para and i + 1 < len(lines) and _RULE.match(lines[i + 1]) and "-" in lines[i + 1]:
            j = next((j for j in range(i + 2, len(lines)) if not lines[j].strip()), len(lines))
            yield {"candidate_type": "table", "text": None, "heading_path": heads.path(), **_at(locator, i + 1, j)}
            i = j
            continue
        elif not line.strip() or _BREAK.match(line):
            yield from flush(i)
        elif _LIST.match(line):
            yield from flush(i)
            para = [_LIST.sub("", line)]
        else:
            para.append(line)
        i += 1
    yield from flush(len(lines))


class _Page(HTMLParser):
    BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "code", "table"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BLOCKS and tag != "code":
            self._end({"p", "h1", "h2", "h3", "h4", "h5", "h6"})
        if tag in self.BLOCKS:
            e = {"tag": tag, "line": self.getpos()[0], "id": dict(attrs).get("id"), "parts": []}
            self.found.append(e)
            self.open.append(e)

    def _end(self, tags: set) -> None:
        if self.open and self.open[-1]["tag"] in tags:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        for e in self.open:
            e["parts"].append(data)


def html(text: str, locator: str) -> Iterator[Row]:
    """Headings, paragraphs, code and tables in document order; code within pre counts as code too."""
    page, heads = _Page(), _Headings()
    page.feed(text)
    page.close()
    for e in page.found:
        tag, spaced = e["tag"], " ".join(x.strip() for x in e["parts"] if x.strip())
        where = f"{locator}#{e['id']}" if e["id"] else f"{locator}:L{e['line']}"
        row: Row = {"locator": where, "line_start": e["line"], "line_end": e["line"]}
        if len(tag) == 2 and tag[0] == "h":
            row |= {"candidate_type": "heading", "text": spaced, "heading_path": heads.push(int(tag[1]), spaced), "metadata": {"level": int(tag[1]), "anchor": e["id"]}}
        else:
            kind = {"table": "table", "p": "section"}.get(tag, "code_block")
            row |= {"candidate_type": kind, "heading_path": heads.path(), "text": None if kind == "table" else spaced if kind == "section" else "".join(e["parts"])}
        yield row


def _pointer(path: tuple[str, ...]) -> str:
    return "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in path)


def _scalar(v: object) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def tree(value: object, locator: str) -> Iterator[Row]:
    """Objects, arrays and scalars of parsed data, depth first, keys sorted, without recursion."""
    todo: list[tuple[object, tuple[str, ...]]] = [(value, ())]
    while todo:
        v, path = todo.pop()
        row: Row = {"locator": locator + ("#" + _pointer(path) if path else ""), "key_path": list(path)}
        if isinstance(v, dict):
            yield row | {"candidate_type": "object", "text": None}
            todo += [(v[k], (*path, str(k))) for k in sorted(v, key=str, reverse=True)]
        elif isinstance(v, list):
            yield row | {"candidate_type": "array", "text": None, "metadata": {"length": len(v)}}
            todo += [(x, (*path, str(n))) for n, x in reversed(list(enumerate(v)))]
        else:
            yield row | {"candidate_type": "scalar", "text": _scalar(v), "metadata": {"value_type": type(v).__name__}}


def load(text: str, kind: str) -> object:
    """Parsed JSON, YAML or TOML; ValueError if it is none."""
    try:
        if kind == "json":
            return json.loads(text)
        if kind == "toml":
            import tomllib

            return tomllib.loads(text)
        import yaml

        return yaml.safe_load(text)
    except Exception as e:
        raise ValueError(f"{kind}_parse_error") from e


def _structured(kind: str) -> Callable[[str, str], Iterator[Row]]:
    return lambda text, locator: tree(load(text, kind), locator)


def _data(text: str, locator: str) -> object:
    return load(text, "json" if locator.split("#")[0].lower().endswith(".json") else "yaml")


def openapi(text: str, locator: str) -> Iterator[Row]:
    """The tree of an interface description, its operations and its component schemas."""
    doc = _data(text, locator)
    yield from tree(doc, locator)
    paths = doc.get("paths") if isinstance(doc, dict) else None
    for path in sorted(p for p in (paths if isinstance(paths, dict) else {}) if isinstance(p, str)):
        for method, op in sorted((paths[path] if isinstance(paths[path], dict) else {}).items()):
            if str(method).lower() in METHODS and isinstance(op, dict):
                said = op.get("summary") or op.get("description")
                oid = op.get("operationId")
                yield {
                    "candidate_type": "endpoint", "text": said if isinstance(said, str) else None, "locator": f"{locator}#/paths/{path}/{method}",
                    "key_path": ["paths", path, method], "endpoint_path": f"{method.upper()} {path}", "metadata": {"operation_id": oid} if isinstance(oid, str) else {},
                }
    parts = doc.get("components") if isinstance(doc, dict) else None
    schemas = parts.get("schemas") if isinstance(parts, dict) else None
    for name, s in sorted((schemas if isinstance(schemas, dict) else {}).items(), key=lambda x: str(x[0])):
        said = s.get("description") if isinstance(s, dict) else None
        yield {
            "candidate_type": "schema", "text": said if isinstance(said, str) else None, "locator": f"{locator}#/components/schemas/{name}",
            "schema_path": ["components", "schemas", str(name)],
        }


def json_schema(text: str, locator: str) -> Iterator[Row]:
    """The tree of a schema, its definitions and its properties."""
    doc = _data(text, locator)
    yield from tree(doc, locator)
    for group in ("$defs", "properties"):
        members = doc.get(group) if isinstance(doc, dict) else None
        for name, s in sorted((members if isinstance(members, dict) else {}).items(), key=lambda x: str(x[0])):
            s = s if isinstance(s, dict) else {}
            meta = {k: str(s[k]) if k == "type" else s[k] for k in ("type", "required") if k in s}
            if "enum" in s:
                meta["enum_count"] = len(s["enum"]) if isinstance(s["enum"], list) else 0
            said = s.get("description")
            yield {
                "candidate_type": "schema_path", "text": said if isinstance(said, str) else None, "locator": f"{locator}#/{group}/{name}",
                "schema_path": [group, str(name)], "metadata": meta,
            }


def python_source(text: str, locator: str) -> Iterator[Row]:
    """Classes and functions with nested paths, signature in its normal spelling, docstring, line range and the file's imports."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ValueError("source_parse_error") from e
    names: set[str] = set()
    for n in ast.walk(module):
        if isinstance(n, ast.Import):
            names |= {a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            names.add(n.module)
    imports = sorted(names)
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(module, ())]
    while todo:
        node, path = todo.pop()
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            path = (*path, node.name)
            is_class = isinstance(node, ast.ClassDef)
            shown = f"class {node.name}" if is_class else f"def {node.name}({ast.unparse(node.args)})"
            yield {
                "candidate_type": "symbol", "text": ast.get_docstring(node), "symbol_path": list(path), "signature_text": shown, "language": "python",
                "metadata": {"symbol_type": "class" if is_class else "function", "imports": imports}, **_at(locator, node.lineno, node.end_lineno or node.lineno),
            }
        todo += [(c, path) for c in reversed(list(ast.iter_child_nodes(node)))]


def openapi_faults(text: str, locator: str) -> list[str]:
    """What breaks the basic rules of an interface description: version, info, paths and the responses of operations."""
    doc = _data(text, locator)
    if not isinstance(doc, dict):
        return ["not a mapping"]
    out = []
    version = doc.get("openapi", doc.get("swagger"))
    if not isinstance(version, str) or not re.match(r"^(?:2\.0|3\.[01](?:\.\d+)?)$", version):
        out.append("openapi version missing or unknown")
    info = doc.get("info")
    out += [f"info.{k} missing" for k in ("title", "version") if not isinstance(info, dict) or not isinstance(info.get(k), str)]
    paths = doc.get("paths")
    if paths is None and isinstance(version, str) and version.startswith("3.1") and (doc.get("components") or doc.get("webhooks")):
        return out
    if not isinstance(paths, dict):
        return [*out, "paths missing"]
    for path, item in paths.items():
        if not isinstance(path, str) or not path.startswith("/"):
            out.append(f"path {path} does not begin with a slash")
        for method, op in item.items() if isinstance(item, dict) else ():
            if str(method).lower() in METHODS and not (isinstance(op, dict) and isinstance(op.get("responses"), dict) and op["responses"]):
                out.append(f"{method} {path} has no responses")
    return out


#: The types of JSON Schema, and its keywords by the kind of value they take.
_TYPES = {"array", "boolean", "integer", "null", "number", "object", "string"}
_SCHEMA_MAPS = ["$defs", "definitions", "properties", "patternProperties", "dependentSchemas"]
_SCHEMA_LISTS = ["allOf", "anyOf", "oneOf", "prefixItems"]
_SCHEMA_ONE = ["additionalProperties", "contains", "else", "if", "items", "not", "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties"]
_COUNTS = ["maxItems", "maxLength", "maxProperties", "minItems", "minLength", "minProperties", "minContains", "maxContains"]
_NUMBERS = ["exclusiveMaximum", "exclusiveMinimum", "maximum", "minimum", "multipleOf"]
_STRINGS = ["$comment", "$id", "$ref", "$schema", "description", "format", "pattern", "title"]


def json_schema_faults(text: str, locator: str) -> list[str]:
    """Keywords of a schema and its sub-schemas whose values are of the wrong kind."""
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    count = lambda v: number(v) and v >= 0 and v == int(v)
    strings = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v) and len(set(v)) == len(v)
    out: list[str] = []
    todo: list[tuple[str, object]] = [("#", _data(text, locator))]
    while todo:
        at, s = todo.pop()
        if isinstance(s, bool):
            continue
        if not isinstance(s, dict):
            out.append(f"{at} is no schema")
            continue
        kind = s.get("type")
        known = lambda v: isinstance(v, str) and v in _TYPES
        if "type" in s and not (known(kind) or isinstance(kind, list) and kind and all(map(known, kind)) and len(set(kind)) == len(kind)):
            out.append(f"{at}/type")
        tests = [("required", strings), ("enum", lambda v: isinstance(v, list)), *[(k, count) for k in _COUNTS], *[(k, number) for k in _NUMBERS], *[(k, lambda v: isinstance(v, str)) for k in _STRINGS]]
        out += [f"{at}/{k}" for k, ok in tests if k in s and not ok(s[k])]
        for k in _SCHEMA_MAPS:
            if k in s:
                if isinstance(s[k], dict):
                    todo += [(f"{at}/{k}/{n}", x) for n, x in s[k].items()]
                else:
                    out.append(f"{at}/{k}")
        for k in _SCHEMA_LISTS:
            if k in s:
                if isinstance(s[k], list) and s[k]:
                    todo += [(f"{at}/{k}/{n}", x) for n, x in enumerate(s[k])]
                else:
                    out.append(f"{at}/{k}")
        todo += [(f"{at}/{k}", s[k]) for k in _SCHEMA_ONE if k in s]
    return sorted(out)


#: Checks whose faults are told beside the candidates, by parser; the code of the diagnostic.
VALIDATORS = {"openapi": (openapi_faults, "openapi_validation_error"), "json_schema": (json_schema_faults, "json_schema_validation_error")}

PARSERS: dict[str, Callable[[str, str], Iterator[Row]]] = {
    "text": paragraphs, "markdown": markdown, "html": html, "json": _structured("json"), "yaml": _structured("yaml"), "toml": _structured("toml"),
    "openapi": openapi, "json_schema": json_schema, "python": python_source,
}
SUFFIXES = {"md": "markdown", "mdx": "markdown", "html": "html", "htm": "html", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "py": "python"}


def choose(path: str | None, role: str | None, language: str | None) -> str:
    """The parser for an artifact: by role first, then by suffix, else plain text; ``none`` for code of other languages."""
    if role == "openapi_spec":
        return "openapi"
    if role == "json_schema":
        return "json_schema"
    name = (path or "").lower().rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1] if "." in name[1:] else ""
    if role in ("source_code", "source"):
        return "python" if language == "python" or suffix == "py" else "none"
    found = SUFFIXES.get(suffix, "text")
    return "text" if found == "python" else found


def by_tools(profile: str, tools: dict[str, dict]) -> str | None:
    """The parser of a profile's tool; a disabled tool names a fallback, and a circle of fallbacks is an error."""
    seen: list[str] = []
    at: str | None = profile
    while at is not None:
        if at in seen:
            raise ValueError("tools fall back in a circle: " + " > ".join([*seen, at]))
        seen.append(at)
        tool = tools.get(at)
        if tool is None:
            return None
        if tool.get("enabled", True) and tool.get("parser") in PARSERS:
            return tool["parser"]
        at = tool.get("fallback")
    return None
