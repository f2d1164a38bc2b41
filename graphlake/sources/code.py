"""Per-file extraction: Python by its own syntax tree, other languages by line patterns.

Both return one table ``path, kind, name, owner, line, end_line, target``: definitions (class, function, method),
imports, calls (target is the callee, owner the innermost definition), bases and, of Python, names used as
values (``indirect``, target is the place: argument, table or getattr). Of component files only the scripts
are read, at their own lines. A file that cannot be parsed gives one ``error`` row and no others.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, kind string, name string, owner string, line int, end_line int, target string"
_COLUMNS = ["path", "kind", "name", "owner", "line", "end_line", "target"]


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join(reversed([*parts, node.id]))
    return None


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.owner, self.rows, self.classes = path, [], [], set()

    def add(self, kind: str, name: str, node: ast.AST, target: str | None = None) -> None:
        self.rows.append((self.path, kind, name, ".".join(self.owner) or None, node.lineno, getattr(node, "end_lineno", None), target))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node)
        self.classes.add(node.name)
        self.owner.append(node.name)
        for base in node.bases:
            if name := _dotted(base):
                self.add("base", node.name, base, name)
        for child in node.body:
            self.visit(child)
        self.owner.pop()

    def _function(self, node) -> None:
        inside = bool(self.owner) and self.owner[-1] in self.classes
        self.add("method" if inside else "function", node.name, node)
        self.owner.append(node.name)
        doc = ast.get_docstring(node)
        if doc and len(doc) > 20:
            self.add("rationale", node.name, node.body[0], " ".join(doc.split())[:80])
        for child in [*node.decorator_list, *node.body]:
            self.visit(child)
        self.owner.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, node, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, node, "." * node.level + (node.module or "") + ":" + a.name)

    def visit_Call(self, node: ast.Call) -> None:
        if name := _dotted(node.func):
            self.add("call", name.rsplit(".", 1)[-1], node, name)
        for given in [*node.args, *(k.value for k in node.keywords)]:
            self.handed_on(given, "argument")
        if name == "getattr" and len(node.args) > 1 and isinstance(node.args[1], ast.Constant) and isinstance(node.args[1].value, str):
            self.add("indirect", node.args[1].value, node, "getattr")
        self.generic_visit(node)

    def handed_on(self, node: ast.AST, context: str) -> None:
        """A name that is used as a value where a function may be meant; local names bind to nothing later."""
        if isinstance(node, ast.Name):
            self.add("indirect", node.id, node, context)

    def visit_Dict(self, node: ast.Dict) -> None:
        for value in node.values:
            self.handed_on(value, "table")
        self.generic_visit(node)

    def visit_List(self, node: ast.List) -> None:
        for value in node.elts:
            self.handed_on(value, "table")
        self.generic_visit(node)

    visit_Tuple = visit_Set = visit_List


def _python(path: str, text: str) -> list[tuple]:
    walk = _Walk(path)
    walk.visit(ast.parse(text))
    return walk.rows


_WORD = r"([A-Za-z_]\w*)"
_TYPES = re.compile(rf"^\s*(?:(?:export|default|public|private|protected|internal|abstract|final|sealed|static|open|data|pub(?:\([^)]*\))?)\s+)*(?:class|interface|struct|enum|trait|protocol|module|object|record|contract|type)\s+{_WORD}(?:[^{{:]*?(?:extends|implements|:|<)\s*{_WORD})?")
_FUNCTIONS = re.compile(rf"^\s*(?:(?:export|default|public|private|protected|internal|static|final|async|inline|override|virtual|open|suspend|pub(?:\([^)]*\))?)\s+)*(?:func|function|fn|def|fun|sub|proc)\s+(?:\([^)]*\)\s*)?(?:self\.)?{_WORD}\s*[(<:]?")
_METHODS = re.compile(rf"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async)\s+)+[\w<>\[\],.? ]+\s+{_WORD}\s*\(")
_IMPORTS = re.compile(r"^\s*(?:import\s+(?:.*?\bfrom\s+)?|from\s+|use\s+|using\s+|require(?:_relative)?\s*\(?\s*|#include\s*)[\"'<]?([\w./:@\\-]+)")
_CALLS = re.compile(rf"(?<![\w.]){_WORD}\s*\(")
_KEYWORDS = frozenset("assert catch class constructor def do elif else elsif except fn for foreach func function fun if import in interface match new not or print return sizeof sub super switch throw try typeof unless until using when while with yield".split())
_COMMENT = re.compile(r"^\s*(?://|#(?!include)|\*|/\*|--)")


_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.S | re.I)
_FENCED = re.compile(r"\A\s*---[ \t]*\n(.*?)^---[ \t]*$", re.S | re.M)


def scripts_only(path: str, text: str) -> str:
    """A component file with all but its scripts blank, line for line: the leading fenced part and script elements."""
    if not path.endswith((".astro", ".vue", ".svelte")):
        return text
    spans = [m.span(1) for m in _SCRIPT.finditer(text)]
    if path.endswith(".astro") and (m := _FENCED.match(text)):
        spans = [m.span(1), *(s for s in spans if s[0] >= m.end())]
    out, place = [], 0
    for a, b in spans:
        out += [re.sub(r"[^\n]", " ", text[place:a]), text[a:b]]
        place = b
    return "".join([*out, re.sub(r"[^\n]", " ", text[place:])])


def _patterns(path: str, text: str) -> list[tuple]:
    text = scripts_only(path, text)
    rows, open_defs, depth = [], [], 0
    for number, line in enumerate(text.split("\n"), 1):
        if _COMMENT.match(line):
            continue
        code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", '""', line)
        while open_defs and depth < open_defs[-1][1]:
            open_defs.pop()
        owner = ".".join(d[0] for d in open_defs) or None
        name = None
        if m := _IMPORTS.match(line):
            rows.append((path, "import", m[1], owner, number, number, m[1]))
        elif m := _TYPES.match(code):
            name = m[1]
            rows.append((path, "class", name, owner, number, number, None))
            if m[2]:
                rows.append((path, "base", name, owner, number, number, m[2]))
        elif (m := _FUNCTIONS.match(code)) or (m := _METHODS.match(code)):
            name = m[1]
            rows.append((path, "method" if owner else "function", name, owner, number, number, None))
        for m in _CALLS.finditer(code):
            if m[1] not in _KEYWORDS and m[1] != name:
                rows.append((path, "call", m[1], ".".join(filter(None, [owner, name if "{" in code else None])) or None, number, number, m[1]))
        depth += code.count("{") - code.count("}")
        if name and "{" in code:
            open_defs.append((name, depth))
    return rows


def extract_code(files: DataFrame) -> DataFrame:
    """Facts of files ``path, content``; each file on its own, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["content"], strict=True):
                try:
                    rows += _python(path, text) if path.endswith((".py", ".pyi")) else _patterns(path, text)
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "error", type(e).__name__, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"line": "Int32", "end_line": "Int32"})

    return files.select("path", "content").mapInPandas(run, FACTS)


def _packages(path: str, text: str) -> list[tuple[str, str, str, str]]:
    """(path, ecosystem, package, dependency); dependency empty for the package itself."""
    name = path.rsplit("/", 1)[-1]
    out = []
    if name == "go.mod":
        own = re.search(r"^module\s+(\S+)", text, re.M)
        block = " ".join(re.findall(r"require\s*\(([^)]*)\)", text)) + "\n" + "\n".join(re.findall(r"^require\s+(\S+\s+\S+)", text, re.M))
        out += [(own[1] if own else "", d) for d in ["", *re.findall(r"([\w./-]+)\s+v[\w.+-]+", block)]]
        kind = "go"
    elif name == "pyproject.toml":
        import tomllib

        project = tomllib.loads(text).get("project", {})
        out += [(project.get("name", ""), d) for d in ["", *(re.match(r"[\w.-]+", x)[0].lower() for x in project.get("dependencies", []))]]
        kind = "python"
    elif name == "Cargo.toml":
        import tomllib

        spec = tomllib.loads(text)
        out += [(spec.get("package", {}).get("name", ""), d) for d in ["", *spec.get("dependencies", {})]]
        kind = "rust"
    elif name == "package.json":
        import json

        spec = json.loads(text)
        out += [(spec.get("name", ""), d) for d in ["", *(d for k in ("dependencies", "devDependencies", "peerDependencies") for d in spec.get(k, {}))]]
        kind = "npm"
    elif name == "pom.xml":
        import xml.etree.ElementTree as Tree

        root = Tree.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
        properties = {p.tag: (p.text or "") for p in root.findall("properties/*")}
        fill = lambda s: re.sub(r"\$\{([^}]+)\}", lambda m: properties.get(m[1], m[0]), s or "")
        own = f"{fill(root.findtext('groupId'))}:{fill(root.findtext('artifactId'))}"
        out += [(own, "")] + [(own, f"{fill(d.findtext('groupId'))}:{fill(d.findtext('artifactId'))}") for d in root.findall("dependencies/dependency")]
        kind = "maven"
    else:
        return []
    return [(path, kind, a, b) for a, b in out]


def manifests(files: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """``path, ecosystem, package, dependency`` of package manifests; broken ones and those over ``most_bytes`` give nothing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["content"], strict=True):
                if len(text.encode()) <= most_bytes:
                    try:
                        rows += _packages(path, text)
                    except Exception:  # noqa: BLE001  any parser's complaint means the file is broken
                        continue
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "package", "dependency"])

    return files.select("path", "content").mapInPandas(run, "path string, ecosystem string, package string, dependency string")
