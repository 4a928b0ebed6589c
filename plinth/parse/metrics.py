"""Cyclomatic complexity and maintainability of Python syntax trees.

Complexity follows McCabe: 1 plus a point for each decision (if, loop, handler,
with-less assert, conditional expression, comprehension part and condition,
boolean operand, match case).  Maintainability is the published index
max(0, 100 (171 - 5.2 ln V - 0.23 G - 16.2 ln L + 50 sin sqrt(2.4 C)) / 171)
with V the Halstead volume, G the complexity of all blocks, L the logical lines
and C the comment share (docstrings count, as comments don't survive parsing).
"""

from __future__ import annotations

import ast
import math

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def decisions(node: ast.AST) -> int:
    """Decision points of one node, its children left out."""
    match node:
        case ast.If() | ast.IfExp() | ast.Assert() | ast.ExceptHandler():
            return 1
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + bool(node.orelse)
        case ast.Try():
            return bool(node.orelse)
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.comprehension():
            return 1 + len(node.ifs)
        case ast.match_case():
            return 0 if isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None else 1
        case ast.Lambda():
            return 1
    return 0


def _own(node: ast.AST):
    """Nodes under ``node`` that aren't inside a nested definition."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (*FUNCTIONS, ast.ClassDef)):
            todo.extend(ast.iter_child_nodes(n))


def function_complexity(node: ast.AST) -> int:
    inner = [n for n in _own(node) if isinstance(n, FUNCTIONS)]
    return 1 + sum(decisions(n) for n in _own(node)) + sum(function_complexity(n) for n in inner)


def class_complexity(node: ast.ClassDef) -> int:
    """Mean complexity of the methods plus one, or 1 without methods."""
    methods = [n for n in node.body if isinstance(n, FUNCTIONS)]
    if not methods:
        return 1 + sum(decisions(n) for n in _own(node))
    return round(sum(map(function_complexity, methods)) / len(methods)) + (0 if len(methods) == 1 else 1)


def blocks(tree: ast.AST) -> list[int]:
    """Complexity of the top-level functions, then of the classes, in order of place."""
    body = [n for n in ast.walk(tree) if isinstance(n, (*FUNCTIONS, ast.ClassDef))]
    nested = {id(m) for n in body for m in ast.walk(n) if m is not n}
    top = [n for n in body if id(n) not in nested]
    return [function_complexity(n) for n in top if isinstance(n, FUNCTIONS)] + [class_complexity(n) for n in top if isinstance(n, ast.ClassDef)]


def first_block(tree: ast.AST) -> int | None:
    found = blocks(tree)
    return found[0] if found else None


def halstead_volume(tree: ast.AST) -> float:
    operators: list[str] = []
    operands: list[str] = []
    for n in ast.walk(tree):
        if isinstance(n, ast.BinOp):
            operators.append(type(n.op).__name__)
            operands += [_operand(n.left), _operand(n.right)]
        elif isinstance(n, ast.UnaryOp):
            operators.append(type(n.op).__name__)
            operands.append(_operand(n.operand))
        elif isinstance(n, ast.BoolOp):
            operators.append(type(n.op).__name__)
            operands += [_operand(v) for v in n.values]
        elif isinstance(n, ast.AugAssign):
            operators.append(type(n.op).__name__)
            operands += [_operand(n.target), _operand(n.value)]
        elif isinstance(n, ast.Compare):
            operators += [type(o).__name__ for o in n.ops]
            operands += [_operand(v) for v in (n.left, *n.comparators)]
    vocabulary = len(set(operators)) + len(set(operands))
    return (len(operators) + len(operands)) * math.log2(vocabulary) if vocabulary > 1 else 0.0


def _operand(n: ast.AST) -> str:
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        return n.attr
    return ast.dump(n)


def maintainability(tree: ast.AST) -> float:
    volume = halstead_volume(tree)
    statements = [n for n in ast.walk(tree) if isinstance(n, ast.stmt)]
    lines = len(statements)
    if volume <= 0 or not lines:
        return 100.0
    docs = sum(isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) for n in statements)
    text = ast.unparse(tree).count("\n") + 1
    share = 100.0 * docs / text
    total = sum(blocks(tree)) or 1 + sum(map(decisions, ast.walk(tree)))
    raw = 171 - 5.2 * math.log(volume) - 0.23 * total - 16.2 * math.log(lines) + 50 * math.sin(math.sqrt(2.4 * math.radians(share)))
    return min(max(0.0, raw * 100 / 171), 100.0)


def is_risky(complexity: int | None, index: float | None) -> bool:
    return bool((complexity and complexity > 10) or (index and index < 65))


def metrics(tree: ast.AST) -> dict:
    """Complexity of the first block, maintainability and the risk flag of a node."""
    complexity, index = first_block(ast.Module([tree], []) if isinstance(tree, ast.stmt) else tree), maintainability(tree)
    return {"cyclomatic": complexity, "maintainability_index": index, "risk_flag": is_risky(complexity, index)}
