"""Endpoints, models, imports, exports and tests of single files: ``ast`` for Python, patterns for JavaScript, Java, Go, C# and Lean."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .kernels import dotted

FACT = "file string, kind string, name string, detail string, parent string, line int"
METHODS = {"get", "post", "put", "patch", "delete", "head", "options"}


def constant(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def python_facts(path: str, text: str) -> list[tuple]:
    """Rows (file, kind, name, detail, parent, line) of a Python file; a file that doesn't parse gives none.

    Endpoints are decorated functions (app.get, router.post, app.route with methods) with the prefix
    of their router; models are classes of declarative bases, Django models and pydantic, with their
    fields; further imports, enums with values, tasks, constants and tests.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows: list[tuple] = []
    add = lambda kind, name, detail, parent, node: rows.append((path, kind, name, detail or "", parent or "", node.lineno))
    prefix = {}
    for s in tree.body:
        if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and isinstance(s.targets[0], ast.Name):
            for k in s.value.keywords:
                if k.arg in ("prefix", "url_prefix") and constant(k.value):
                    prefix[s.targets[0].id] = constant(k.value)
        if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Name) and s.targets[0].id.isupper() and isinstance(s.value, ast.Constant):
            add("constant", s.targets[0].id, repr(s.value.value), "", s)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                add("import", a.name, "*", "", node)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                add("import", "." * node.level + (node.module or ""), a.name, "", node)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            if node.name.startswith("test_"):
                add("test", node.name, ast.get_docstring(node), "", node)
            for d in node.decorator_list:
                call = d if isinstance(d, ast.Call) else None
                name = dotted(call.func if call else d) or ""
                owner, _, verb = name.rpartition(".")
                route = constant(call.args[0]) if call and call.args else None
                if route is not None and verb in METHODS:
                    add("endpoint", f"{verb.upper()} {prefix.get(owner, '')}{route}", node.name, owner, node)
                elif route is not None and verb == "route":
                    listed = next((k.value for k in call.keywords if k.arg == "methods"), None)
                    for m in [constant(x) for x in listed.elts] if isinstance(listed, ast.List | ast.Tuple) else ["GET"]:
                        add("endpoint", f"{m} {prefix.get(owner, '')}{route}", node.name, owner, node)
                elif verb in ("task", "shared_task"):
                    add("task", node.name, "celery", owner, node)
        elif isinstance(node, ast.ClassDef):
            bases = [dotted(b) or "" for b in node.bases]
            if any(b.split(".")[-1] in ("Enum", "StrEnum", "IntEnum") for b in bases):
                values = [t.targets[0].id for t in node.body if isinstance(t, ast.Assign) and isinstance(t.targets[0], ast.Name)]
                add("enum", node.name, ",".join(values), "", node)
                continue
            framework = next((f for b in bases for f, names in (("pydantic", ("BaseModel",)), ("django", ("models.Model",)), ("sqlalchemy", ("Base", "DeclarativeBase", "db.Model"))) if b in names or b.split(".")[-1] in names), None)
            if framework:
                add("model", node.name, framework, "", node)
                for t in node.body:
                    target = t.target if isinstance(t, ast.AnnAssign) else t.targets[0] if isinstance(t, ast.Assign) else None
                    if isinstance(target, ast.Name) and not target.id.startswith("__"):
                        key = next((constant(c.args[0]) for c in ast.walk(t) if isinstance(c, ast.Call) and (dotted(c.func) or "").endswith("ForeignKey") and c.args and constant(c.args[0])), "")
                        add("field", target.id, key, node.name, t)
    return rows


JS_IMPORT = re.compile(r"(?m)^\s*import\s+(?:(?:type\s+)?([\w$]+|\*\s+as\s+[\w$]+|\{[^}]*\})(?:\s*,\s*(\{[^}]*\}))?\s+from\s+)?[\"']([^\"']+)[\"']|require\(\s*[\"']([^\"']+)[\"']\s*\)")
JS_EXPORT = re.compile(r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)")
JS_ROUTE = re.compile(r"\b(\w*(?:app|router|server|api)\w*)\.(get|post|put|patch|delete|all)\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*(?:async\s*)?([\w$.]*)", re.I)
JS_TEST = re.compile(r"\b(describe|it|test)\(\s*[\"'`]([^\"'`]+)[\"'`]")
JS_CALL = re.compile(r"\b(?:fetch\(\s*[\"'`]([^\"'`]+)[\"'`](?:[^)]*?method:\s*[\"'](\w+)[\"'])?|(?:axios|client|api|http)\.(get|post|put|patch|delete)(?:<[^>]*>)?\(\s*[\"'`]([^\"'`]+)[\"'`])")
JSX_TAG = re.compile(r"<([A-Z]\w*)[\s/>]")
CLASS_ROUTE = {
    "java": re.compile(r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public|private|protected)?[\w<>\[\], ?]*?\s(\w+)\s*\("),
    "cs": re.compile(r"\[Http(Get|Post|Put|Patch|Delete)\(\"([^\"]*)\"\)\]\s*(?:\[[^\]]*\]\s*)*(?:public|private|protected)[\w<>\[\], ?]*?\s(\w+)\s*\("),
    "go": re.compile(r"\.(GET|POST|PUT|PATCH|DELETE|HandleFunc)\(\s*\"([^\"]+)\"\s*,\s*([\w.]+)"),
}
LEAN = re.compile(r"(?m)^\s*(namespace|end|theorem|lemma|def)\s+([\w.']+)")


def pattern_facts(path: str, text: str) -> list[tuple]:
    rows: list[tuple] = []
    line = lambda m: text.count("\n", 0, m.start()) + 1
    suffix = path.rsplit(".", 1)[-1]
    if suffix in ("ts", "tsx", "js", "jsx", "mjs", "cjs"):
        for m in JS_IMPORT.finditer(text):
            named = (m[1] or "") + (m[2] or "")
            symbols = [s.split(" as ")[0].strip() for s in re.sub(r"[{}]", ",", named).split(",") if s.strip()] if "{" in named else ["*"]
            rows += [(path, "import", m[3] or m[4], s.removeprefix("type "), "", line(m)) for s in symbols]
        rows += [(path, "export", m[1], "", "", line(m)) for m in JS_EXPORT.finditer(text)]
        rows += [(path, "endpoint", f"{'ANY' if m[2].lower() == 'all' else m[2].upper()} {m[3]}", m[4], m[1], line(m)) for m in JS_ROUTE.finditer(text)]
        suite = ""
        for m in JS_TEST.finditer(text):
            if m[1] == "describe":
                suite = m[2]
            else:
                rows.append((path, "test", m[2], "", suite, line(m)))
        rows += [(path, "call", f"{(m[2] or m[3] or 'GET').upper()} {m[1] or m[4]}", "", "", line(m)) for m in JS_CALL.finditer(text)]
        if suffix in ("tsx", "jsx"):
            rows += [(path, "component", t, "", "", 0) for t in dict.fromkeys(JSX_TAG.findall(text))]
    elif suffix in CLASS_ROUTE:
        for m in CLASS_ROUTE[suffix].finditer(text):
            rows.append((path, "endpoint", f"{'ANY' if m[1] == 'HandleFunc' else m[1].upper()} {m[2]}", m[3], "", line(m)))
    elif suffix == "lean":
        stack: list[str] = []
        for m in LEAN.finditer(text):
            if m[1] == "namespace":
                stack.append(m[2])
            elif m[1] == "end":
                if stack and stack[-1] == m[2]:
                    stack.pop()
            else:
                body = text[m.end() : (n.start() if (n := LEAN.search(text, m.end())) else len(text))]
                rows.append((path, m[1], ".".join([*stack, m[2]]), "sorry" if re.search(r"\bsorry\b", body) else "", ".".join(stack), line(m)))
    return rows


def file_facts(files: DataFrame) -> DataFrame:
    """The facts of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = [r for p, t in zip(x["path"], x["content"], strict=True) for r in (python_facts if p.endswith(".py") else pattern_facts)(p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FACT.split(", ")])

    return files.select("path", "content").mapInPandas(run, FACT)


PRINT = "id string, hash string, size int, kinds array<string>"


def normal_kind(node: ast.AST) -> str:
    return "Identifier" if isinstance(node, ast.Name | ast.arg) else "Literal" if isinstance(node, ast.Constant) else type(node).__name__


def structure(node: ast.AST) -> list[str]:
    """Kinds of a function's nodes in pre-order; names and literals count as such, contexts not at all."""
    out, stack = [], [*reversed(node.body)]
    while stack:
        x = stack.pop()
        if isinstance(x, ast.expr_context):
            continue
        out.append(normal_kind(x))
        stack += reversed(list(ast.iter_child_nodes(x)))
    return out


def fingerprints(files: DataFrame) -> DataFrame:
    """(id, hash, size, kinds) of each Python function: SHA-1 of its kinds joined by '|'."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for path, text in zip(x["path"], x["content"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for f in ast.walk(tree):
                    if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                        kinds = structure(f)
                        rows.append((f"{path}#{f.name}", hashlib.sha1("|".join(kinds).encode()).hexdigest(), len(kinds), list(dict.fromkeys(kinds))))
            yield pd.DataFrame(rows, columns=["id", "hash", "size", "kinds"])

    return files.filter("path like '%.py'").select("path", "content").mapInPandas(run, PRINT)


def entrypoints(paths: list[str]) -> list[str]:
    """Files by which programs start: main, app, server, manage and index files, command folders."""
    return [p for p in paths if re.search(r"(^|/)(main|app|server|manage|wsgi|asgi|cli|index|__main__)\.(py|ts|js|go|java|cs)$|(^|/)cmd/[^/]+/", p)]


def embedding_text(name: str, file: str, calls: list[str], literals: list[str]) -> str:
    """What stands for a function before an encoder: name, file name, ten calls, five short literals; 300 characters."""
    short = [x[:100] for x in literals[:5]]
    return " ".join([name, file.rsplit("/", 1)[-1], *calls[:10], *short])[:300]
