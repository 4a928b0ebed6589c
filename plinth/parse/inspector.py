"""File and definition metadata of one Python source text.

Statements inside function bodies aren't counted.  A class yields itself, its
direct methods as ``Class.name``, and then its body, in which methods appear
again as functions and nested classes as classes; functions inside functions
don't appear.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import sys
import tokenize

from plinth.parse.metrics import FUNCTIONS, metrics

CONCURRENT = ("asyncio", "concurrent.futures", "multiprocessing", "threading")
COMPREHENSIONS = {ast.ListComp: "list", ast.DictComp: "dict", ast.SetComp: "set", ast.GeneratorExp: "generator"}
COUNTERS = {ast.For: "loop_count", ast.While: "loop_count", ast.If: "branch_count", ast.Try: "exception_blocks", ast.Raise: "exception_raises"}


def calls_of(node: ast.AST) -> list[str]:
    """Distinct simple names that are called anywhere under a node, sorted."""
    out = set()
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                out.add(n.func.id)
            elif isinstance(n.func, ast.Attribute):
                out.add(n.func.attr)
    return sorted(out)


def definition(source: str, node: ast.stmt, category: str, parent: str | None = None) -> dict:
    text = ast.get_source_segment(source, node) or ""
    arguments = node.args.args if isinstance(node, FUNCTIONS) else []
    hinted = isinstance(node, FUNCTIONS) and (node.returns is not None or any(a.annotation is not None for a in arguments))
    return {
        "name": f"{parent}.{node.name}" if parent else node.name,
        "category": category,
        "start_line": node.lineno,
        "end_line": node.end_lineno,
        "line_count": node.end_lineno - node.lineno + 1,
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "decorators": [ast.unparse(d) for d in node.decorator_list],
        "docstring": ast.get_docstring(node),
        "outbound_calls": calls_of(node),
        "parents": [ast.unparse(b) for b in node.bases] if isinstance(node, ast.ClassDef) else [],
        "source_text": text,
        "source_hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        "has_type_hints": hinted,
        "metrics": metrics(node),
    }


def comment_count(source: str) -> int:
    try:
        return sum(t.type == tokenize.COMMENT for t in tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return 0


def inspect_source(source: str) -> dict:
    """Metadata of a file; raises SyntaxError or ValueError where it can't be parsed."""
    tree = ast.parse(source)
    out = {
        "imports": [], "declared_variables": set(), "comprehension_patterns": {}, "loop_count": 0, "branch_count": 0, "exception_blocks": 0,
        "exception_raises": 0, "regex_patterns": int(bool(re.search(r"\bimport\s+re\b", source))), "generator_count": 0, "uses_async": False,
        "inheritance": False, "definitions": [],
    }
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, FUNCTIONS):
            out["uses_async"] |= isinstance(node, ast.AsyncFunctionDef)
            out["definitions"].append(definition(source, node, "function"))
            continue
        if isinstance(node, ast.ClassDef):
            out["inheritance"] |= bool(node.bases)
            out["definitions"].append(definition(source, node, "class"))
            out["definitions"] += [definition(source, n, "method", node.name) for n in node.body if isinstance(n, FUNCTIONS)]
        elif isinstance(node, ast.Import):
            out["imports"] += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append(node.module or "")
        elif isinstance(node, ast.Assign):
            out["declared_variables"].update(t.id for t in node.targets if isinstance(t, ast.Name))
        if type(node) in COUNTERS:
            out[COUNTERS[type(node)]] += 1
        if kind := COMPREHENSIONS.get(type(node)):
            out["comprehension_patterns"][kind] = out["comprehension_patterns"].get(kind, 0) + 1
            out["generator_count"] += kind == "generator"
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    out["declared_variables"] = sorted(out["declared_variables"])
    out["stdlib_imports"] = [m for m in out["imports"] if m in sys.stdlib_module_names]
    out["concurrent_libs"] = sorted(set(out["imports"]) & set(CONCURRENT))
    out["module_docstring"] = ast.get_docstring(tree)
    out["comment_count"] = comment_count(source)
    out["oop_patterns"] = {"inheritance": out.pop("inheritance"), "polymorphism": False, "dunder": False}
    out["metrics"] = metrics(tree)
    return out
