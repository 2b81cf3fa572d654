"""Per-file extraction of functions: the ast module for Python, patterns for other languages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FUNCTION = "id string, name string, file string, line_start int, line_end int, calls array<string>, string_literals array<string>, is_async boolean, language string"
LANGUAGE = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "go": "go", "cs": "csharp", "lean": "lean4"}
HEADS = {
    "typescript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(async\s+)?(?:function\s+(\w+)|(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)",
    "java": r"(?m)^\s*(?:public|private|protected)(\s+static)?[\w<>\[\], ]*\s(\w+)\s*\([^)]*\)()\s*(?:throws [\w, ]+)?\{",
    "go": r"(?m)^func\s+(\([^)]*\)\s*)?(\w+)()\s*\(",
    "csharp": r"(?m)^\s*(?:public|private|protected|internal)(?:\s+static|\s+override|\s+virtual)*(\s+async)?[\w<>\[\], ?]*\s(\w+)\s*\([^)]*\)()\s*(?:\{|=>|\n)",
    "lean4": r"(?m)^()(?:theorem|lemma|def|abbrev|instance)\s+([\w.']+)()",
}
HEADS["javascript"] = HEADS["typescript"]
CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")
LITERAL = re.compile(r"\"([^\"\\\n]{1,200})\"|'([^'\\\n]{1,200})'")
# Words before a parenthesis that are no calls.
KEYWORDS = {"if", "for", "while", "switch", "return", "catch", "function", "func", "new", "throw", "await", "typeof", "lock", "using", "foreach"}


def dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else parts[0] if parts else None


def python_functions(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows = []
    for f in ast.walk(tree):
        if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            inside = list(ast.walk(f))
            calls = dict.fromkeys(c for x in inside if isinstance(x, ast.Call) and (c := dotted(x.func)))
            strings = dict.fromkeys(x.value for x in inside if isinstance(x, ast.Constant) and isinstance(x.value, str))
            rows.append((f"{path}#{f.name}:{f.lineno}", f.name, path, f.lineno, f.end_lineno, list(calls), list(strings), isinstance(f, ast.AsyncFunctionDef), "python"))
    return rows


def pattern_functions(path: str, text: str, language: str) -> list[tuple]:
    """A function reaches to the next head or the end of the file."""
    heads = list(re.finditer(HEADS[language], text))
    rows = []
    for i, m in enumerate(heads):
        body = text[m.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)]
        name = m[2] or m[3]
        first = text.count("\n", 0, m.start(2) if m[2] else m.start(3)) + 1
        calls = [c for c in dict.fromkeys(CALL.findall(body)) if c not in KEYWORDS]
        strings = list(dict.fromkeys(a or b for a, b in LITERAL.findall(body)))
        rows.append((f"{path}#{name}:{first}", name, path, first, first + body.rstrip().count("\n"), calls, strings, "async" in (m[1] or "") or "async" in m[0], language))
    return rows


def functions(files: DataFrame) -> DataFrame:
    """Function records of files (path, content); files in unknown languages or that don't parse give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["content"], strict=True):
                language = LANGUAGE.get(path.rsplit(".", 1)[-1])
                if language and text:
                    rows += python_functions(path, text) if language == "python" else pattern_functions(path, text, language)
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FUNCTION.split(", ")])

    return files.select("path", "content").mapInPandas(run, FUNCTION)
