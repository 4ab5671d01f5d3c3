"""Functions, imports, definitions, annotations and tests of Python files, as one table of facts.

Files are parsed where they lie (``mapInPandas``); every fact is a row with a
kind, so one pass over the files serves all later operators.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "repo_id string, file string, kind string, name string, line int, end_line int, value int, extra string"


def complexity(node: ast.AST) -> int:
    """One more than the branches of a function, without those of functions inside it."""
    total, todo = 1, list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.Match):
            total += len(n.cases)
        todo.extend(ast.iter_child_nodes(n))
    return total


def _slots(node: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[int, int]:
    """Annotated and all type slots: parameters but self and cls, and the return."""
    a = node.args
    named = [x for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.arg not in ("self", "cls")]
    extra = sum(x is not None for x in (a.vararg, a.kwarg))
    return sum(x.annotation is not None for x in named) + (node.returns is not None), len(named) + extra + 1


def _assertions(node: ast.AST) -> int:
    """Assert statements, and calls of ``self.assert...`` and ``self.fail``."""
    total = 0
    for n in ast.walk(node):
        if isinstance(n, ast.Assert):
            total += 1
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id == "self":
            total += n.func.attr.startswith("assert") or n.func.attr == "fail"
    return total


def facts_of(text: str) -> Iterator[tuple[str, str, int, int, int, str]]:
    """(kind, name, line, end line, value, extra) of one file; a file that does not parse gives an error row."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        yield "error", type(e).__name__, 0, 0, 0, str(e)[:200]
        return

    def visit(node: ast.AST, prefix: str) -> Iterator[tuple[str, str, int, int, int, str]]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{prefix}{child.name}"
                yield "function", name, child.lineno, child.end_lineno or child.lineno, complexity(child), ""
                typed, slots = _slots(child)
                yield "typed_slots", name, child.lineno, child.end_lineno or child.lineno, typed, ""
                yield "slots", name, child.lineno, child.end_lineno or child.lineno, slots, ""
                if child.name.startswith("test_"):
                    yield "test", name, child.lineno, child.end_lineno or child.lineno, _assertions(child), ""
                yield from visit(child, prefix)
            elif isinstance(child, ast.ClassDef):
                yield from visit(child, f"{child.name}.")
            else:
                yield from visit(child, prefix)

    yield from visit(tree, "")
    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not n.name.startswith("_"):
            yield "export", n.name, n.lineno, n.end_lineno or n.lineno, int(ast.get_docstring(n) is not None), "type" if isinstance(n, ast.ClassDef) else "func"
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for alias in n.names:
                yield "import", alias.name, n.lineno, n.end_lineno or n.lineno, 0, ""
        elif isinstance(n, ast.ImportFrom):
            yield "import", n.module or "", n.lineno, n.end_lineno or n.lineno, n.level, ""
            for alias in n.names:
                yield "imported_name", alias.name, n.lineno, n.end_lineno or n.lineno, n.level, n.module or ""


def python_facts(files: DataFrame) -> DataFrame:
    """All facts of Python files (repo_id, rel_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_id", "file", "kind", "name", "line", "end_line", "value", "extra"]
        for batch in batches:
            rows = [(r, p, *f) for r, p, c in zip(batch["repo_id"], batch["rel_path"], batch["content"], strict=True) for f in facts_of(bytes(c or b"").decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("repo_id", "rel_path", "content").mapInPandas(run, SCHEMA)
