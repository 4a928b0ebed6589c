"""Definitions and usages of names in one Python source text.

Function and class names are defined in the scope around them, positional
parameters at the line of their ``def``; decorators, defaults and annotations
belong to the inner scope.  An annotated assignment defines its name once, and a
plain one carries its right-hand side.  With ``compat`` both are recorded as the
original tool does: annotated twice, plain without a source.
"""

from __future__ import annotations

import ast

from plinth.parse.metrics import FUNCTIONS


class _Names(ast.NodeVisitor):
    def __init__(self, compat: bool):
        self.compat, self.scopes, self.rows, self.value = compat, ["global"], [], None

    def _define(self, name: str, line: int, kind: str, hint: str | None = None, source: str | None = None) -> None:
        self.rows.append({"is_definition": True, "name": name, "line_number": line, "scope": self.scopes[-1], "kind": kind, "type_hint": hint, "value_source": source})

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Store):
            self._define(node.id, node.lineno, "assignment", source=None if self.compat else self.value)
        else:
            kind = "read" if isinstance(node.ctx, ast.Load) else "delete"
            self.rows.append({"is_definition": False, "name": node.id, "line_number": node.lineno, "scope": self.scopes[-1], "kind": kind, "type_hint": None, "value_source": None})

    def _function(self, node):
        self._define(node.name, node.lineno, "function")
        self.scopes.append(f"function:{node.name}")
        for a in node.args.args:
            self._define(a.arg, node.lineno, "parameter", ast.unparse(a.annotation) if a.annotation else None)
        self.generic_visit(node)
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node):
        self._define(node.name, node.lineno, "class")
        self.scopes.append(f"class:{node.name}")
        self.generic_visit(node)
        self.scopes.pop()

    def visit_Import(self, node):
        for a in node.names:
            self._define(a.asname or a.name, node.lineno, "import", source=a.name)

    def visit_ImportFrom(self, node):
        for a in node.names:
            self._define(a.asname or a.name, node.lineno, "import", source=f"{node.module or ''}.{a.name}")

    def visit_Assign(self, node):
        self.visit(node.value)
        self.value = ast.unparse(node.value)
        for t in node.targets:
            self.visit(t)
        self.value = None

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name):
            self._define(node.target.id, node.lineno, "assignment", ast.unparse(node.annotation), ast.unparse(node.value) if node.value else None)
            if self.compat:
                self.visit(node.target)
        else:
            self.visit(node.target)
        self.visit(node.annotation)
        if node.value:
            self.visit(node.value)


def variable_rows(source: str, compat: bool = False) -> list[dict]:
    """Tagged rows, in order of the walk."""
    names = _Names(compat)
    names.visit(ast.parse(source))
    return names.rows


def names_in(expression: str | None) -> list[str]:
    """Distinct names an expression mentions, sorted; empty where it can't be parsed."""
    try:
        return sorted({n.id for n in ast.walk(ast.parse(expression or "")) if isinstance(n, ast.Name)})
    except (SyntaxError, ValueError):
        return []


__all__ = ["FUNCTIONS", "names_in", "variable_rows"]
