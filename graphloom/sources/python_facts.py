"""Facts of Python files: symbols, imports, calls, references and complexity, by the standard parser.

A file that doesn't parse gives an empty record with has_parse_errors.
"""

from __future__ import annotations

import ast

FILE = "<file>"


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


def complexity_of(node: ast.AST) -> int:
    """1 and the decisions of a function, without those of functions inside it."""
    total, work = 1, list(ast.iter_child_nodes(node))
    while work:
        n = work.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            continue
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            total += 1
        elif isinstance(n, ast.comprehension):
            total += 1 + len(n.ifs)
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.match_case) and not (isinstance(n.pattern, ast.MatchAs) and n.pattern.pattern is None):
            total += 1
        work += ast.iter_child_nodes(n)
    return total


class Reader(ast.NodeVisitor):
    """Collects the facts of one module."""

    def __init__(self):
        self.functions, self.classes, self.imports, self.exports, self.calls, self.references, self.complexity = ([] for _ in range(7))
        self.container: str | None = None

    def module(self, tree: ast.Module) -> None:
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.functions.append({"name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "exported": True})
                self._inside(node.name, [node])
            elif isinstance(node, ast.ClassDef):
                own = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                methods = [{"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno} for n in own]
                bases = [b for b in map(_dotted, node.bases) if b]
                self.classes.append({"name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "exported": True, "methods": methods, "extends": bases})
                for n in own:
                    self._inside(node.name if n.name == "__init__" else f"{node.name}.{n.name}", [n])
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for alias in node.names:
                    self._import(alias.name, node.lineno, namespace=alias.asname or alias.name.split(".")[0])
            elif isinstance(node, ast.ImportFrom):
                self._import("." * node.level + (node.module or ""), node.lineno, named=[a.asname or a.name for a in node.names])
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.complexity.append({"name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "complexity": complexity_of(node)})
            elif isinstance(node, ast.Lambda):
                self.complexity.append({"name": f"@{node.lineno}", "start_line": node.lineno, "end_line": node.end_lineno, "complexity": complexity_of(node)})
        self._references(tree)

    def _import(self, specifier: str, line: int, namespace: str | None = None, named: list[str] | None = None) -> None:
        self.imports.append({"specifier": specifier, "default_import": None, "namespace_import": namespace, "named_imports": named or [], "line": line})

    def _inside(self, container: str, nodes: list[ast.AST]) -> None:
        for top in nodes:
            for node in ast.walk(top):
                if isinstance(node, ast.Call) and (site := self._call(node.func)):
                    kind, owner, name = site
                    self.calls.append({"kind": kind, "object": owner, "name": name, "line": node.lineno, "container": container})

    @staticmethod
    def _call(f: ast.AST) -> tuple[str, str | None, str] | None:
        if isinstance(f, ast.Name):
            return "plain", None, f.id
        if isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super":
                return "super", None, f.attr
            owner = _dotted(f.value)
            if owner in ("self", "cls"):
                return "self", owner, f.attr
            return ("member", owner, f.attr) if owner else None
        return None

    def _references(self, tree: ast.Module) -> None:
        """Names that are read and are neither called nor bound."""
        called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
        for node in ast.walk(tree):
            if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and id(node) not in called:
                self.references.append({"name": node.id, "line": node.lineno, "container": FILE})


EMPTY = {"functions": [], "classes": [], "imports": [], "exports": [], "calls": [], "references": [], "complexity": []}


def read(content: bytes | None) -> dict:
    """The facts of a file, or an empty record with has_parse_errors."""
    try:
        reader = Reader()
        reader.module(ast.parse((content or b"").decode("utf-8")))
    except (SyntaxError, ValueError, RecursionError):
        return EMPTY | {"has_parse_errors": True}
    reader.calls.sort(key=lambda c: c["line"])
    return {k: getattr(reader, k) for k in EMPTY} | {"has_parse_errors": False}
