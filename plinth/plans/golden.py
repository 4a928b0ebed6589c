"""Rows that the queries over sources and commits must give, by reading the sources; as SQL.

Hashes are computed in SQL from the text of each block.
"""

from __future__ import annotations

#: Query: columns with their SQL types, and rows.
ROWS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    "file_metadata": (
        {"path": "VARCHAR", "imports": "VARCHAR", "stdlib_imports": "VARCHAR", "declared_variables": "VARCHAR", "loop_count": "INTEGER", "branch_count": "INTEGER", "exception_blocks": "INTEGER", "exception_raises": "INTEGER", "regex_patterns": "INTEGER", "generator_count": "INTEGER", "comment_count": "INTEGER", "uses_async": "BOOLEAN", "concurrent_libs": "VARCHAR", "module_docstring": "VARCHAR", "parsed": "BOOLEAN"},
        [
            ('broken.py', None, None, None, None, None, None, None, None, None, None, None, None, None, False),
            ('prices.py', 'shop', '', '', 0, 0, 0, 0, 0, 0, 1, False, '', None, True),
            ('shop.py', 're,os.path,prices,threading', 're,threading', 'codes,limit', 0, 0, 0, 0, 1, 0, 0, True, 'threading', 'Order handling.', True),
        ],
    ),
    "definitions": (
        {"path": "VARCHAR", "ordinal": "INTEGER", "name": "VARCHAR", "category": "VARCHAR", "start_line": "INTEGER", "end_line": "INTEGER", "line_count": "INTEGER", "is_async": "BOOLEAN", "decorators": "VARCHAR", "docstring": "VARCHAR", "outbound_calls": "VARCHAR", "parents": "VARCHAR", "has_type_hints": "BOOLEAN"},
        [
            ('prices.py', 0, 'lookup', 'function', 4, 9, 6, False, '', None, '', '', False),
            ('prices.py', 1, 'sum_up', 'function', 12, 17, 6, False, '', None, 'lookup', '', False),
            ('prices.py', 2, 'tally', 'function', 20, 21, 2, False, '', None, 'len', '', False),
            ('prices.py', 3, 'spare', 'function', 24, 26, 3, False, '', None, 'zip', '', False),
            ('shop.py', 0, 'Basket', 'class', 12, 21, 10, False, '', 'Goods before payment.', 'append,range', 'object', False),
            ('shop.py', 1, 'Basket.__init__', 'method', 15, 17, 3, False, '', None, '', '', False),
            ('shop.py', 2, 'Basket.add', 'method', 19, 21, 3, False, '', None, 'append,range', '', True),
            ('shop.py', 3, '__init__', 'function', 15, 17, 3, False, '', None, '', '', False),
            ('shop.py', 4, 'add', 'function', 19, 21, 3, False, '', None, 'append,range', '', True),
            ('shop.py', 5, 'submit', 'function', 24, 28, 5, True, '', None, 'ValueError,tally', '', False),
            ('shop.py', 6, 'tally', 'function', 31, 37, 7, False, '', 'Sum of the prices.', 'lookup', '', False),
        ],
    ),
    "cyclomatic": (
        {"path": "VARCHAR", "ordinal": "INTEGER", "name": "VARCHAR", "cyclomatic": "INTEGER", "risk_flag": "BOOLEAN"},
        [
            ('prices.py', 0, 'lookup', 2, False),
            ('prices.py', 1, 'sum_up', 4, False),
            ('prices.py', 2, 'tally', 1, False),
            ('prices.py', 3, 'spare', 2, False),
            ('shop.py', 0, 'Basket', 3, False),
            ('shop.py', 1, 'Basket.__init__', 1, False),
            ('shop.py', 2, 'Basket.add', 2, False),
            ('shop.py', 3, '__init__', 1, False),
            ('shop.py', 4, 'add', 2, False),
            ('shop.py', 5, 'submit', 2, False),
            ('shop.py', 6, 'tally', 4, False),
        ],
    ),
    "import_edges": (
        {"src": "VARCHAR", "dst": "VARCHAR"},
        [
            ('prices.py', 'shop.py'),
            ('shop.py', 'prices.py'),
        ],
    ),
    "code_name_variants": (
        {"name": "VARCHAR", "position": "INTEGER", "path": "VARCHAR", "is_base": "BOOLEAN", "n_implementations": "BIGINT", "diff_from_base": "VARCHAR"},
        [
            ('tally', 1, 'prices.py', True, 2, ''),
            ('tally', 2, 'shop.py', False, 2, '--- \n+++ \n@@ -1,2 +1,7 @@\n def tally(values):\n-    return len(values)\n+    """Sum of the prices."""\n+    result = 0\n+    for v in values:\n+        if v is not None and v > 0:\n+            result += prices.lookup(v)\n+    return result'),
        ],
    ),
    "code_blocks": (
        {"block_id": "BIGINT", "path": "VARCHAR", "ordinal": "INTEGER", "start_line": "INTEGER", "end_line": "INTEGER", "content": "VARCHAR"},
        [
            (0, 'prices.py', 0, 4, 9, 'def lookup(item):\n    # one price for all\n    try:\n        return item * 2\n    except TypeError:\n        return 0'),
            (1, 'prices.py', 1, 12, 17, 'def sum_up(numbers):\n    total = 10\n    for n in numbers:\n        if n is not None and n > 5:\n            total += lookup(n)\n    return total'),
            (2, 'prices.py', 2, 24, 26, 'def spare():\n    unused = limit\n    return {k: v for k, v in zip("ab", "cd")}'),
            (3, 'shop.py', 0, 12, 21, 'class Basket(object):\n    """Goods before payment."""\n\n    def __init__(self, owner):\n        self.owner = owner\n        self.items = []\n\n    def add(self, item, n: int = 1) -> None:\n        for _ in range(n):\n            self.items.append(item)'),
            (4, 'shop.py', 1, 24, 28, 'async def submit(basket):\n    if not basket.items:\n        raise ValueError("empty")\n    total = tally(basket.items)\n    return total'),
            (5, 'shop.py', 2, 31, 37, 'def tally(values):\n    """Sum of the prices."""\n    result = 0\n    for v in values:\n        if v is not None and v > 0:\n            result += prices.lookup(v)\n    return result'),
            (6, 'shop.py', 3, 15, 17, 'def __init__(self, owner):\n        self.owner = owner\n        self.items = []'),
            (7, 'shop.py', 4, 19, 21, 'def add(self, item, n: int = 1) -> None:\n        for _ in range(n):\n            self.items.append(item)'),
        ],
    ),
    "normalized_code": (
        {"block_id": "BIGINT", "normalized": "VARCHAR"},
        [
            (0, 'def func_0(arg_0):\n    try:\n        return item * 0\n    except TypeError:\n        return 0'),
            (1, 'def func_0(arg_0):\n    var_1 = 0\n    for var_2 in numbers:\n        if var_2 is not None and var_2 > 0:\n            var_1 += lookup(var_2)\n    return var_1'),
            (2, "def func_0():\n    var_1 = limit\n    return {k: v for var_2, var_3 in zip('<str>', '<str>')}"),
            (3, 'class class_0(object):\n\n    def func_1(arg_0, arg_1):\n        self.owner = owner\n        self.items = []\n\n    def func_2(arg_0, arg_1, arg_2: int=None) -> None:\n        for var_3 in range(n):\n            self.items.append(item)'),
            (4, "async def submit(arg_0):\n    if not basket.items:\n        raise ValueError('<str>')\n    var_0 = tally(basket.items)\n    return var_0"),
            (5, 'def func_0(arg_0):\n    var_1 = 0\n    for var_2 in values:\n        if var_2 is not None and var_2 > 0:\n            var_1 += prices.lookup(var_2)\n    return var_1'),
            (6, 'def func_0(arg_0, arg_1):\n    self.owner = owner\n    self.items = []'),
            (7, 'def func_0(arg_0, arg_1, arg_2: int=None) -> None:\n    for var_1 in range(n):\n        self.items.append(item)'),
        ],
    ),
    "code_variant_groups": (
        {"block_id": "BIGINT", "leader": "BIGINT"},
        [
            (1, 1),
            (3, 3),
            (5, 1),
            (7, 3),
        ],
    ),
    "merged_variants": (
        {"leader": "BIGINT", "base_block": "BIGINT", "original_blocks": "VARCHAR", "affected_files": "VARCHAR", "n_changes": "INTEGER"},
        [
            (1, 5, '1,5', 'prices.py,shop.py', 1),
            (3, 3, '3,7', 'shop.py', 1),
        ],
    ),
    "variable_rows": (
        {"path": "VARCHAR", "is_definition": "BOOLEAN", "name": "VARCHAR", "line_number": "INTEGER", "scope": "VARCHAR", "kind": "VARCHAR", "type_hint": "VARCHAR", "value_source": "VARCHAR"},
        [
            ('prices.py', False, 'TypeError', 8, 'function:lookup', 'read', None, None),
            ('prices.py', False, 'item', 7, 'function:lookup', 'read', None, None),
            ('prices.py', False, 'k', 26, 'function:spare', 'read', None, None),
            ('prices.py', False, 'len', 21, 'function:tally', 'read', None, None),
            ('prices.py', False, 'limit', 25, 'function:spare', 'read', None, None),
            ('prices.py', False, 'lookup', 16, 'function:sum_up', 'read', None, None),
            ('prices.py', False, 'n', 15, 'function:sum_up', 'read', None, None),
            ('prices.py', False, 'n', 15, 'function:sum_up', 'read', None, None),
            ('prices.py', False, 'n', 16, 'function:sum_up', 'read', None, None),
            ('prices.py', False, 'numbers', 14, 'function:sum_up', 'read', None, None),
            ('prices.py', False, 'total', 17, 'function:sum_up', 'read', None, None),
            ('prices.py', False, 'v', 26, 'function:spare', 'read', None, None),
            ('prices.py', False, 'values', 21, 'function:tally', 'read', None, None),
            ('prices.py', False, 'zip', 26, 'function:spare', 'read', None, None),
            ('prices.py', True, 'item', 4, 'function:lookup', 'parameter', None, None),
            ('prices.py', True, 'k', 26, 'function:spare', 'assignment', None, None),
            ('prices.py', True, 'lookup', 4, 'global', 'function', None, None),
            ('prices.py', True, 'n', 14, 'function:sum_up', 'assignment', None, None),
            ('prices.py', True, 'numbers', 12, 'function:sum_up', 'parameter', None, None),
            ('prices.py', True, 'shop', 1, 'global', 'import', None, 'shop'),
            ('prices.py', True, 'spare', 24, 'global', 'function', None, None),
            ('prices.py', True, 'sum_up', 12, 'global', 'function', None, None),
            ('prices.py', True, 'tally', 20, 'global', 'function', None, None),
            ('prices.py', True, 'total', 13, 'function:sum_up', 'assignment', None, '10'),
            ('prices.py', True, 'total', 16, 'function:sum_up', 'assignment', None, None),
            ('prices.py', True, 'unused', 25, 'function:spare', 'assignment', None, 'limit'),
            ('prices.py', True, 'v', 26, 'function:spare', 'assignment', None, None),
            ('prices.py', True, 'values', 20, 'function:tally', 'parameter', None, None),
            ('shop.py', False, 'ValueError', 26, 'function:submit', 'read', None, None),
            ('shop.py', False, 'basket', 25, 'function:submit', 'read', None, None),
            ('shop.py', False, 'basket', 27, 'function:submit', 'read', None, None),
            ('shop.py', False, 'c', 9, 'global', 'read', None, None),
            ('shop.py', False, 'c', 9, 'global', 'read', None, None),
            ('shop.py', False, 'float', 7, 'global', 'read', None, None),
            ('shop.py', False, 'int', 19, 'function:add', 'read', None, None),
            ('shop.py', False, 'item', 21, 'function:add', 'read', None, None),
            ('shop.py', False, 'n', 20, 'function:add', 'read', None, None),
            ('shop.py', False, 'object', 12, 'class:Basket', 'read', None, None),
            ('shop.py', False, 'owner', 16, 'function:__init__', 'read', None, None),
            ('shop.py', False, 'prices', 36, 'function:tally', 'read', None, None),
            ('shop.py', False, 'range', 20, 'function:add', 'read', None, None),
            ('shop.py', False, 'result', 37, 'function:tally', 'read', None, None),
            ('shop.py', False, 'self', 16, 'function:__init__', 'read', None, None),
            ('shop.py', False, 'self', 17, 'function:__init__', 'read', None, None),
            ('shop.py', False, 'self', 21, 'function:add', 'read', None, None),
            ('shop.py', False, 'tally', 27, 'function:submit', 'read', None, None),
            ('shop.py', False, 'total', 28, 'function:submit', 'read', None, None),
            ('shop.py', False, 'v', 35, 'function:tally', 'read', None, None),
            ('shop.py', False, 'v', 35, 'function:tally', 'read', None, None),
            ('shop.py', False, 'v', 36, 'function:tally', 'read', None, None),
            ('shop.py', False, 'values', 34, 'function:tally', 'read', None, None),
            ('shop.py', True, 'Basket', 12, 'global', 'class', None, None),
            ('shop.py', True, 'Lock', 5, 'global', 'import', None, 'threading.Lock'),
            ('shop.py', True, 'RATE', 7, 'global', 'assignment', 'float', '0.19'),
            ('shop.py', True, '_', 20, 'function:add', 'assignment', None, None),
            ('shop.py', True, '__init__', 15, 'class:Basket', 'function', None, None),
            ('shop.py', True, 'add', 19, 'class:Basket', 'function', None, None),
            ('shop.py', True, 'basket', 24, 'function:submit', 'parameter', None, None),
            ('shop.py', True, 'c', 9, 'global', 'assignment', None, None),
            ('shop.py', True, 'codes', 9, 'global', 'assignment', None, "[c for c in 'abc' if c]"),
            ('shop.py', True, 'item', 19, 'function:add', 'parameter', None, None),
            ('shop.py', True, 'limit', 8, 'global', 'assignment', None, '10'),
            ('shop.py', True, 'n', 19, 'function:add', 'parameter', 'int', None),
            ('shop.py', True, 'os.path', 3, 'global', 'import', None, 'os.path'),
            ('shop.py', True, 'owner', 15, 'function:__init__', 'parameter', None, None),
            ('shop.py', True, 'prices', 4, 'global', 'import', None, 'prices'),
            ('shop.py', True, 're', 2, 'global', 'import', None, 're'),
            ('shop.py', True, 'result', 33, 'function:tally', 'assignment', None, '0'),
            ('shop.py', True, 'result', 36, 'function:tally', 'assignment', None, None),
            ('shop.py', True, 'self', 15, 'function:__init__', 'parameter', None, None),
            ('shop.py', True, 'self', 19, 'function:add', 'parameter', None, None),
            ('shop.py', True, 'submit', 24, 'global', 'function', None, None),
            ('shop.py', True, 'tally', 31, 'global', 'function', None, None),
            ('shop.py', True, 'total', 27, 'function:submit', 'assignment', None, 'tally(basket.items)'),
            ('shop.py', True, 'v', 34, 'function:tally', 'assignment', None, None),
            ('shop.py', True, 'values', 31, 'function:tally', 'parameter', None, None),
        ],
    ),
    "variable_flows": (
        {"name": "VARCHAR", "definition_count": "BIGINT", "usage_count": "BIGINT", "is_redefined": "BOOLEAN", "is_orphan": "BOOLEAN", "is_undefined": "BOOLEAN", "definitions": "INTEGER", "usages": "INTEGER"},
        [
            ('Basket', 1, 0, False, True, False, 1, 0),
            ('Lock', 1, 0, False, True, False, 1, 0),
            ('RATE', 1, 0, False, True, False, 1, 0),
            ('TypeError', 0, 1, False, False, True, 0, 1),
            ('ValueError', 0, 1, False, False, True, 0, 1),
            ('_', 1, 0, False, False, False, 1, 0),
            ('__init__', 1, 0, False, False, False, 1, 0),
            ('add', 1, 0, False, True, False, 1, 0),
            ('basket', 1, 2, False, False, False, 1, 2),
            ('c', 1, 2, False, False, False, 1, 2),
            ('codes', 1, 0, False, True, False, 1, 0),
            ('float', 0, 1, False, False, True, 0, 1),
            ('int', 0, 1, False, False, True, 0, 1),
            ('item', 2, 2, True, False, False, 2, 2),
            ('k', 1, 1, False, False, False, 1, 1),
            ('len', 0, 1, False, False, True, 0, 1),
            ('limit', 1, 1, False, False, False, 1, 1),
            ('lookup', 1, 1, False, False, False, 1, 1),
            ('n', 2, 4, True, False, False, 2, 4),
            ('numbers', 1, 1, False, False, False, 1, 1),
            ('object', 0, 1, False, False, True, 0, 1),
            ('os.path', 1, 0, False, True, False, 1, 0),
            ('owner', 1, 1, False, False, False, 1, 1),
            ('prices', 1, 1, False, False, False, 1, 1),
            ('range', 0, 1, False, False, True, 0, 1),
            ('re', 1, 0, False, True, False, 1, 0),
            ('result', 2, 1, True, False, False, 2, 1),
            ('self', 2, 3, True, False, False, 2, 3),
            ('shop', 1, 0, False, True, False, 1, 0),
            ('spare', 1, 0, False, True, False, 1, 0),
            ('submit', 1, 0, False, True, False, 1, 0),
            ('sum_up', 1, 0, False, True, False, 1, 0),
            ('tally', 2, 1, True, False, False, 2, 1),
            ('total', 3, 2, True, False, False, 3, 2),
            ('unused', 1, 0, False, True, False, 1, 0),
            ('v', 2, 4, True, False, False, 2, 4),
            ('values', 2, 2, True, False, False, 2, 2),
            ('zip', 0, 1, False, False, True, 0, 1),
        ],
    ),
    "variable_report": (
        {"total_count": "BIGINT", "orphaned_count": "BIGINT", "undefined_count": "BIGINT"},
        [
            (38, 12, 8),
        ],
    ),
    "variable_dependencies": (
        {"src": "VARCHAR", "dst": "VARCHAR"},
        [
            ('codes', 'c'),
            ('total', 'basket'),
            ('total', 'tally'),
            ('unused', 'limit'),
        ],
    ),
    "call_graph": (
        {"src": "VARCHAR", "dst": "VARCHAR"},
        [
            ('submit', 'tally'),
            ('sum_up', 'lookup'),
            ('tally', 'lookup'),
        ],
    ),
    "call_levels": (
        {"node": "VARCHAR", "level": "INTEGER"},
        [
            ('lookup', 0),
            ('submit', 2),
            ('sum_up', 1),
            ('tally', 1),
        ],
    ),
    "uncalled_definitions": (
        {"path": "VARCHAR", "name": "VARCHAR", "category": "VARCHAR"},
        [
            ('prices.py', 'spare', 'function'),
            ('prices.py', 'sum_up', 'function'),
            ('shop.py', 'Basket', 'class'),
            ('shop.py', 'add', 'function'),
            ('shop.py', 'submit', 'function'),
        ],
    ),
    "project_dashboard": (
        {"files": "BIGINT", "functions": "BIGINT", "classes": "BIGINT", "methods": "BIGINT", "avg_complexity": "DOUBLE", "documented_share": "DOUBLE", "orphans": "BIGINT", "variants": "BIGINT"},
        [
            (3, 8, 1, 2, 2.1818181818181817, 0.18181818181818182, 5, 1),
        ],
    ),
    "external_packages": (
        {"package": "VARCHAR", "imports": "BIGINT"},
        [
            ('os', 1),
        ],
    ),
    "history_events": (
        {"ord": "INTEGER", "commit_hash": "VARCHAR", "event_type": "VARCHAR", "affected_definitions": "VARCHAR", "before_hash": "VARCHAR", "after_hash": "VARCHAR", "confidence": "DOUBLE", "description": "VARCHAR"},
        [
            (0, 'ghi789', 'rename', 'old_name.py,new_name.py', 'def456', 'ghi789', 1.0, 'Renamed old_name.py to new_name.py'),
            (1, 'def456', 'extract', '', 'abc123', 'def456', 0.7, 'Refactor authentication module'),
        ],
    ),
    "history_churn": (
        {"path": "VARCHAR", "churn": "BIGINT"},
        [
            ('file1', 3),
            ('file2', 1),
        ],
    ),
    "history_hotspots": (
        {"path": "VARCHAR", "churn": "BIGINT"},
        [
            ('file1', 3),
        ],
    ),
    "history_contributors": (
        {"author": "VARCHAR", "commits": "BIGINT"},
        [
            ('Author 1', 2),
            ('Author 2', 1),
        ],
    ),
    "history_timeline": (
        {"ord": "INTEGER", "hash": "VARCHAR", "avg_complexity": "DOUBLE"},
        [
            (0, 'ghi789', 4.0),
            (1, 'def456', 5.0),
            (2, 'abc123', 5.0),
        ],
    ),
    "history_trends": (
        {"path": "VARCHAR", "n_points": "BIGINT", "max_value": "DOUBLE", "min_value": "DOUBLE", "current_value": "DOUBLE", "direction": "VARCHAR"},
        [
            ('file1', 3, 7.0, 4.0, 4.0, 'stable'),
        ],
    ),
    "history_of_a_file": (
        {"hash": "VARCHAR", "files_changed": "VARCHAR", "insertions": "INTEGER", "deletions": "INTEGER"},
        [
            ('ghi789', 'new_name.py', 0, 0),
        ],
    ),
    "history_limited": (
        {"hash": "VARCHAR", "files_changed": "VARCHAR"},
        [
            ('def456', 'file2'),
        ],
    ),
    "history_renames": (
        {"hash": "VARCHAR", "rename_from": "VARCHAR", "rename_to": "VARCHAR"},
        [
            ('ghi789', 'old_name.py', 'new_name.py'),
        ],
    ),
    "history_major": (
        {"hash": "VARCHAR", "score": "INTEGER"},
        [
            ('abc123', 100),
            ('def456', 120),
        ],
    ),
    "history_uniform": (
        {"hash": "VARCHAR"},
        [
            ('def456',),
            ('ghi789',),
        ],
    ),
    "history_between": (
        {"hash": "VARCHAR"},
        [
            ('def456',),
        ],
    ),
    "patched_files": (
        {"path": "VARCHAR"},
        [
            ('prices.py',),
            ('shop.py',),
        ],
    ),
    "variable_users": (
        {"src": "VARCHAR", "dst": "VARCHAR"},
        [
            ('__init__', 'owner'),
            ('__init__', 'self'),
            ('add', 'item'),
            ('add', 'n'),
            ('add', 'self'),
            ('lookup', 'item'),
            ('spare', 'k'),
            ('spare', 'limit'),
            ('spare', 'v'),
            ('submit', 'basket'),
            ('submit', 'tally'),
            ('submit', 'total'),
            ('sum_up', 'lookup'),
            ('sum_up', 'n'),
            ('sum_up', 'numbers'),
            ('sum_up', 'total'),
            ('tally', 'prices'),
            ('tally', 'result'),
            ('tally', 'v'),
            ('tally', 'values'),
        ],
    ),
    "class_edges": (
        {"src": "VARCHAR", "dst": "VARCHAR"},
        [
            ('object', 'Basket'),
        ],
    ),
    "lines_per_file": (
        {"path": "VARCHAR", "lines": "BIGINT"},
        [
            ('prices.py', 17),
            ('shop.py', 34),
        ],
    ),
    "most_called": (
        {"name": "VARCHAR", "callers": "BIGINT"},
        [
            ('lookup', 2),
        ],
    ),
    "documentation": (
        {"documented": "BIGINT", "undocumented": "BIGINT"},
        [
            (2, 9),
        ],
    ),
    "undocumented_definitions": (
        {"path": "VARCHAR", "name": "VARCHAR", "category": "VARCHAR", "start_line": "INTEGER"},
        [
            ('prices.py', 'lookup', 'function', 4),
            ('prices.py', 'spare', 'function', 24),
            ('prices.py', 'sum_up', 'function', 12),
            ('prices.py', 'tally', 'function', 20),
        ],
    ),
    "multi_defined_names": (
        {"name": "VARCHAR", "definition_count": "BIGINT", "usage_count": "BIGINT"},
        [
            ('item', 2, 2),
            ('n', 2, 4),
            ('total', 3, 2),
        ],
    ),
}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "chr(10)".join(f"'{part}'" for part in value.replace("'", "''").split("\n")).replace("chr(10)", " || chr(10) || ")
    return str(value).upper() if isinstance(value, bool) else repr(value)


def values_sql(name: str) -> str:
    columns, rows = ROWS[name]
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    hashed = ", sha256(content) AS hash" if name == "code_blocks" else ""
    return f"SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in columns.items())}{hashed} FROM (VALUES {body}) AS t({', '.join(columns)})"


ORACLE_SQL: dict[str, str] = {name: values_sql(name) for name in ROWS}
