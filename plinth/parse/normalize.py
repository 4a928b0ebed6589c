"""Renaming-invariant normal form of Python code, diffs and code blocks."""

from __future__ import annotations

import ast
import difflib
import hashlib
from collections import Counter, deque

from plinth.parse.metrics import FUNCTIONS


class _Normal(ast.NodeTransformer):
    """One pass a step of the normal form, in the order of ``normalize``."""

    def __init__(self, step: str):
        self.step, self.names = step, {}

    def _named(self, kind: str, name: str) -> str:
        return self.names.setdefault(name, f"{kind}_{len(self.names)}")

    def visit_Expr(self, node):
        if self.step == "docs" and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            return None
        return self.generic_visit(node)

    def visit_Name(self, node):
        if self.step == "names":
            if isinstance(node.ctx, ast.Store):
                node.id = self._named("var", node.id)
            elif node.id in self.names:
                node.id = self.names[node.id]
        return node

    def visit_FunctionDef(self, node):
        if self.step == "names":
            node.name = self._named("func", node.name)
        return self.generic_visit(node)

    def visit_ClassDef(self, node):
        if self.step == "names":
            node.name = self._named("class", node.name)
        return self.generic_visit(node)

    def visit_Constant(self, node):
        if self.step == "literals" and not isinstance(node.value, (bool, bytes)) and node.value is not None:
            if isinstance(node.value, str):
                return ast.copy_location(ast.Constant("<str>"), node)
            if isinstance(node.value, int):
                return ast.copy_location(ast.Constant(0), node)
            if isinstance(node.value, (float, complex)):
                return ast.copy_location(ast.Constant(0.0), node)
        return node

    def visit_List(self, node):
        if self.step == "literals" and node.elts and isinstance(node.ctx, ast.Load):
            return ast.copy_location(ast.List([ast.Constant("<item>")], ast.Load()), node)
        return self.generic_visit(node)

    def visit_Dict(self, node):
        if self.step == "literals" and node.keys:
            return ast.copy_location(ast.Dict([ast.Constant("<key>")], [ast.Constant("<value>")]), node)
        return self.generic_visit(node)

    def visit_Import(self, node):
        if self.step == "imports":
            return ast.copy_location(ast.Import([ast.alias("<module>")]), node)
        return node

    def visit_ImportFrom(self, node):
        if self.step == "imports":
            return ast.copy_location(ast.ImportFrom("<module>", [ast.alias("<name>")], 0), node)
        return node

    def visit_arguments(self, node):
        if self.step == "arguments":
            for i, a in enumerate(node.args):
                a.arg = f"arg_{i}"
            for i, a in enumerate(node.kwonlyargs):
                a.arg = f"kwarg_{i}"
            node.defaults = [ast.Constant(None) for _ in node.defaults]
            node.kw_defaults = [d and ast.Constant(None) for d in node.kw_defaults]
            return node
        return self.generic_visit(node)


def normalize(code: str) -> str:
    """Code without docstrings, with names, literals, imports and arguments made
    uniform; unparsable code comes back as it is."""
    try:
        tree = ast.parse(code)
        for step in ("docs", "names", "literals", "imports", "arguments"):
            tree = _Normal(step).visit(tree)
        return ast.unparse(ast.fix_missing_locations(tree))
    except (SyntaxError, ValueError, AttributeError):
        return code


def tokens(text: str) -> list[str]:
    """Words and single symbols, lower case."""
    import re

    return re.findall(r"\w+|[^\w\s]", text.lower())


def token_vector(text: str, width: int = 256) -> list[float]:
    """Hashed token counts of unit length (zeros for an empty text): the default embedding."""
    counts = Counter(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") % width for t in tokens(text))
    norm = sum(n * n for n in counts.values()) ** 0.5 or 1.0
    out = [0.0] * width
    for k, n in counts.items():
        out[k] = n / norm
    return out


def unified_diff(base: str | None, other: str | None) -> list[str]:
    """Lines of a unified diff with three lines of context; empty for equal texts."""
    return list(difflib.unified_diff((base or "").splitlines(), (other or "").splitlines(), lineterm=""))


def code_blocks(source: str, min_lines: int = 5) -> list[dict]:
    """Every function and class, nested ones too, breadth first, of at least ``min_lines`` lines."""
    out, queue = [], deque([ast.parse(source)])
    while queue:
        node = queue.popleft()
        queue.extend(ast.iter_child_nodes(node))
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            text = ast.get_source_segment(source, node) or ""
            if len(text.splitlines()) >= min_lines:
                out.append({"ordinal": len(out), "start_line": node.lineno, "end_line": node.end_lineno, "content": text})
    return out


def merge_sources(contents: list[str]) -> tuple[int, str]:
    """(index of the base, merged text): the base has most syntax nodes; the text
    holds every definition once, told apart by its normal form, first seen first."""
    trees = [ast.parse(c) for c in contents]
    base = max(range(len(trees)), key=lambda i: sum(1 for _ in ast.walk(trees[i])))
    bodies: dict[str, ast.stmt] = {}
    for text, tree in zip(contents, trees, strict=True):
        for node in ast.walk(tree):
            if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
                bodies.setdefault(normalize(ast.get_source_segment(text, node) or ""), node)
    return base, ast.unparse(ast.fix_missing_locations(ast.Module(list(bodies.values()), [])))
