import ast

import pytest

from plinth.parse import inspector, metrics, normalize, variables

SAMPLE = '''"""Doc."""
import re, os
from threading import Lock
from . import sibling

x = y = 1
z: int = 2


class Box(Base):
    """A box."""

    def get(self):
        return [i for i in self.items]

    async def put(self, v: int):
        if v > 1 and v < 9:
            self.items.append(v)


def outer(a, b=2):  # a comment
    def inner():
        return print(a)
    for k in a:
        while k:
            k -= 1
    return inner()


flags = {k: 1 for k in "ab"}
try:
    raise ValueError(list(c for c in "x"))
except ValueError:
    pass
'''


def test_definitions_follow_the_traversal():
    out = inspector.inspect_source(SAMPLE)
    got = [(d["name"], d["category"]) for d in out["definitions"]]
    assert got == [("Box", "class"), ("Box.get", "method"), ("Box.put", "method"), ("get", "function"), ("put", "function"), ("outer", "function")]
    by = {d["name"]: d for d in out["definitions"]}
    assert by["outer"]["outbound_calls"] == ["inner", "print"] and by["Box"]["parents"] == ["Base"] and by["put"]["is_async"] and by["put"]["has_type_hints"] and not by["outer"]["has_type_hints"]
    assert by["Box"]["docstring"] == "A box." and len(by["Box"]["source_hash"]) == 64 and by["outer"]["line_count"] == 7


def test_file_counters_skip_function_bodies():
    out = inspector.inspect_source(SAMPLE)
    assert out["imports"] == ["re", "os", "threading", ""] and out["stdlib_imports"] == ["re", "os", "threading"] and out["concurrent_libs"] == ["threading"]
    assert out["declared_variables"] == ["flags", "x", "y"] and out["loop_count"] == 0 and out["branch_count"] == 0
    assert out["exception_blocks"] == 1 and out["exception_raises"] == 1 and out["comprehension_patterns"] == {"dict": 1, "generator": 1} and out["generator_count"] == 1
    assert out["comment_count"] == 1 and out["uses_async"] and out["oop_patterns"]["inheritance"] and out["module_docstring"] == "Doc." and out["regex_patterns"] == 1
    with pytest.raises(SyntaxError):
        inspector.inspect_source("def x(:")


def test_two_functions_of_the_small_sample():
    text = 'def hello():\n    """Say it."""\n    print("hello")\n\n\ndef goodbye():\n    """Say it."""\n    print("bye")\n'
    out = inspector.inspect_source(text)
    assert {d["name"] for d in out["definitions"]} == {"hello", "goodbye"} and all(d["outbound_calls"] == ["print"] and d["docstring"] for d in out["definitions"])
    assert all(d["metrics"] == {"cyclomatic": 1, "maintainability_index": 100.0, "risk_flag": False} for d in out["definitions"])


@pytest.mark.parametrize(
    ("body", "want"),
    [("return 1", 1), ("if a:\n  pass", 2), ("if a and b or c:\n  pass", 4), ("for i in a:\n  pass\n else:\n  pass", 3), ("return [i for i in a if i]", 3), ("try:\n  pass\n except E:\n  pass\n except F:\n  pass", 3), ("return 1 if a else 2", 2)],
)
def test_complexity(body, want):
    tree = ast.parse(f"def f(a, b, c):\n {body}\n")
    assert metrics.first_block(tree) == want
    assert metrics.first_block(ast.parse("x = 1")) is None


def test_risk_and_maintainability():
    assert metrics.is_risky(11, 90) and metrics.is_risky(None, 60) and not metrics.is_risky(10, 65) and not metrics.is_risky(None, None) and not metrics.is_risky(0, 0)
    busy = "def f(x):\n" + "".join(f" if x > {k}:\n  x = x * {k} + x\n" for k in range(40))
    assert 0 < metrics.maintainability(ast.parse(busy)) < metrics.maintainability(ast.parse("def f(x):\n return x + 1")) <= 100


def test_normal_form_ignores_names_docs_and_literals():
    a = 'def total(values):\n    """Sum."""\n    result = 0\n    for v in values:\n        result += v\n    return result'
    b = "def summed(values):\n    acc = 5\n    for item in values:\n        acc += item\n    return acc"
    assert normalize.normalize(a) == normalize.normalize(b) != a
    assert normalize.normalize("def x(:") == "def x(:"
    assert normalize.normalize("import os\nfrom a import b") == "import <module>\nfrom <module> import <name>"
    assert normalize.normalize("x = [1, 2]\ny = {'a': 1}\nz = True") == "var_0 = ['<item>']\nvar_1 = {'<key>': '<value>'}\nvar_2 = True"


def test_diff_blocks_and_merge():
    assert normalize.unified_diff("a\nb", "a\nc")[:2] == ["--- ", "+++ "] and normalize.unified_diff("a", "a") == []
    found = normalize.code_blocks("def a():\n  x = 1\n  def b():\n    y = 2\n    return y\n  return x\n", 3)
    assert [(b["start_line"], b["end_line"]) for b in found] == [(1, 6), (3, 5)]
    base, text = normalize.merge_sources(["def f(a):\n return a", "def f(a):\n if a:\n  return 1\n return a"])
    assert base == 1 and text.count("def f") == 2
    assert sum(x * x for x in normalize.token_vector("a b a")) == pytest.approx(1) and not any(normalize.token_vector(""))


def test_variable_rows():
    text = "import a.b as c\nfrom d import e\nx = c + 1\ny: int = x\ndef f(p, *q):\n    z = p\n    del z\nclass K:\n    w = f\n"
    rows = variables.variable_rows(text)
    defs = [(r["name"], r["scope"], r["kind"]) for r in rows if r["is_definition"]]
    assert defs == [("c", "global", "import"), ("e", "global", "import"), ("x", "global", "assignment"), ("y", "global", "assignment"), ("f", "global", "function"), ("p", "function:f", "parameter"), ("z", "function:f", "assignment"), ("K", "global", "class"), ("w", "class:K", "assignment")]
    assert [r["value_source"] for r in rows if r["is_definition"]][:4] == ["a.b", "d.e", "c + 1", "x"]
    assert ("z", "delete") in [(r["name"], r["kind"]) for r in rows if not r["is_definition"]]
    assert [r["name"] for r in variables.variable_rows(text, compat=True) if r["is_definition"]].count("y") == 2
    assert variables.names_in("a + b(c)") == ["a", "b", "c"] and variables.names_in("][") == []
