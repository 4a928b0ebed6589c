import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import graph, history, relational, similarity


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


GRAPHS = {
    "chain": [("a", "b"), ("b", "c")], "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "b")], "loop": [("a", "a"), ("a", "b")], "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")],
    "two": [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("y", "x")], "empty": [],
}


def reach(pairs):
    out = {(a, b) for a, b in pairs}
    while True:
        new = out | {(a, d) for a, b in out for c, d in out if b == c}
        if new == out:
            return out
        out = new


@pytest.mark.parametrize("name", GRAPHS)
def test_graph_against_brute_force(spark, name):
    pairs = GRAPHS[name]
    e, closure = edges(spark, pairs), reach(pairs)
    nodes = {x for p in pairs for x in p}
    assert {tuple(r) for r in graph.transitive_closure(e).collect()} == closure
    scc = {r["node"]: r["component"] for r in graph.strongly_connected(e).collect()}
    assert scc == {n: min([m for m in nodes if (n, m) in closure and (m, n) in closure] + [n]) for n in nodes}
    assert {r[0] for r in graph.entry_points(e).collect()} == nodes - {b for _, b in pairs}
    assert {r[0] for r in graph.leaf_nodes(e).collect()} == nodes - {a for a, _ in pairs}

    def level(n):
        below = [level(b) if (b, b) not in closure else None for a, b in set(pairs) if a == n]
        return None if (n, n) in closure or None in below else 1 + max(below) if below else 0

    assert {r["node"]: r["level"] for r in graph.dependency_levels(e).collect()} == {n: level(n) for n in nodes if level(n) is not None}
    order = {r["node"]: r["position"] for r in graph.initialization_order(e).collect()}
    assert sorted(order.values()) == list(range(1, len(nodes) + 1))
    assert all(order[a] < order[b] for a, b in pairs if scc[a] != scc[b])
    back = {r["node"]: r["position"] for r in graph.initialization_order(e, dependencies_first=True).collect()}
    assert all(back[a] > back[b] for a, b in pairs if scc[a] != scc[b])


def test_cycles_are_all_simple_cycles(spark):
    rng = random.Random(1)
    pairs = sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(16)})
    found, todo = set(), [[a] for a in {a for a, _ in pairs}]
    while todo:
        path = todo.pop()
        for a, b in pairs:
            if a == path[-1]:
                if b == path[0]:
                    found.add(tuple(path))
                elif b > path[0] and b not in path:
                    todo.append([*path, b])
    got = [tuple(r["cycle"]) for r in graph.cycles(edges(spark, pairs)).collect()]
    assert sorted(got) == sorted(found) and len(set(got)) == len(got)
    with pytest.raises(ValueError):
        graph.cycles(edges(spark, [(f"m{k}", f"m{(k + 1) % 9}") for k in range(9)]), max_length=3)


def brute_cycles(pairs):
    """Every simple cycle from its least node."""
    found, todo = set(), [[a] for a in {a for a, _ in pairs}]
    while todo:
        path = todo.pop()
        for a, b in pairs:
            if a == path[-1]:
                if b == path[0]:
                    found.add(tuple(path))
                elif b > path[0] and b not in path:
                    todo.append([*path, b])
    return found


@pytest.mark.parametrize("task_edges", [0, 3, 1000])
def test_components_in_rounds(spark, task_edges):
    rng = random.Random(task_edges)
    for n, m in ((12, 14), (12, 24), (20, 20)):
        pairs = sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})
        closure = reach(pairs)
        nodes = {x for p in pairs for x in p}
        want = {k: min([j for j in nodes if (k, j) in closure and (j, k) in closure] + [k]) for k in nodes}
        got = graph.strongly_connected(edges(spark, [*pairs, ("zz", None)]), task_edges).collect()
        assert {r["node"]: r["component"] for r in got} == want | {"zz": "zz"} and len(got) == len(nodes) + 1
        assert all(r["size"] == list(want.values()).count(r["component"]) for r in got if r["node"] != "zz")


def test_components_of_a_long_tail_and_ring(spark):
    """The closure of this graph has over 200 million pairs."""
    e = spark.range(20_000).select(F.col("id").alias("src"), F.when(F.col("id") == 19_999, F.lit(17_000)).otherwise(F.col("id") + 1).alias("dst"))
    got = graph.strongly_connected(e).groupBy("component", "size").count().where("count > 1").collect()
    assert [tuple(r) for r in got] == [(17_000, 3000, 3000)]


def test_long_cycles_take_few_rounds(spark):
    """A round a node would take 300 rounds."""
    ring = [(f"a{k:03}", f"a{(k + 1) % 300:03}") for k in range(300)]
    loop = [("a150", "b0"), *[(f"b{k}", f"b{k + 1}") for k in range(60)], ("b60", "a150"), ("b60", "a151"), ("b5", "b5"), ("tail", "a000")]
    pairs = ring + loop
    got = [tuple(r["cycle"]) for r in graph.cycles(edges(spark, pairs), 1000).collect()]
    assert sorted(got) == sorted(brute_cycles(pairs)) and len(got) == 4
    rng = random.Random(5)
    for _ in range(3):
        pairs = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(17)})
        got = [tuple(r["cycle"]) for r in graph.cycles(edges(spark, pairs)).collect()]
        assert sorted(got) == sorted(brute_cycles(pairs))


@pytest.mark.parametrize("limit", [0, 1000])
def test_closure_by_rounds_and_by_walks(spark, limit):
    rng = random.Random(limit)
    for n, m in ((14, 15), (14, 30), (40, 40)):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        got = [tuple(r) for r in graph.transitive_closure(edges(spark, [*pairs, (None, "n1")]), max_broadcast=limit).collect()]
        assert sorted(got) == sorted(reach(pairs))
    chain = [(f"c{k:02}", f"c{k + 1:02}") for k in range(30)]
    assert graph.transitive_closure(edges(spark, chain), max_broadcast=limit).count() == 30 * 31 // 2
    assert graph.transitive_closure(edges(spark, []), max_broadcast=limit).count() == 0


def test_closure_walks_in_small_groups(spark):
    rng = random.Random(7)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)})
    for cells in (1, 70):
        got = [tuple(r) for r in graph._walked(edges(spark, pairs), cells, 4).collect()]
        assert sorted(got) == sorted(reach(pairs))


def test_closure_of_a_long_path_meets_each_pair_once(spark):
    """Joined with itself in every round, the closure meets each pair at all nodes between: 4.5 billion rows."""
    e = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.transitive_closure(e).count() == 3000 * 3001 // 2


def test_degrees_and_centrality(spark):
    d = {r["node"]: (r["dependency_count"], r["dependent_count"]) for r in graph.degrees(edges(spark, GRAPHS["diamond"])).collect()}
    assert d == {"a": (2, 0), "b": (1, 1), "c": (1, 1), "d": (0, 2)}
    assert {r[0]: r[1] for r in graph.degree_centrality(edges(spark, GRAPHS["diamond"])).collect()}["a"] == 2 / 3
    assert {r[0]: r[1] for r in graph.reverse_graph(edges(spark, GRAPHS["diamond"])).collect()}["d"] == ["b", "c"]


def test_greedy_groups_are_the_serial_ones(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(90)})
    pairs = [(a, b) for a, b in pairs if a != b]
    used, want = set(), {}
    for a in range(60):
        if a in used:
            continue
        members = [b for x, b in pairs if x == a and b not in used]
        for b in members:
            want[b] = a
            used.add(b)
        if members:
            want[a] = a
        used.add(a)
    got = similarity.greedy_groups(None, spark.createDataFrame(pairs, "id_a bigint, id_b bigint"), "v")
    assert {r[0]: r[1] for r in got.collect()} == want


def test_similarity_pairs_are_exact(spark):
    rng = random.Random(0)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(90)] + [(90, [0.0] * 6), (91, None), (92, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(a, b) for a, x in rows[:90] for b, y in rows[:90] if a < b and dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 >= 0.6}
    for size in (7, 1000):
        assert {(r[0], r[1]) for r in similarity.similarity_pairs(df, "id", {"v": 1.0}, 0.6, size).collect()} == want


def test_similarity_pairs_and_groups_at_odd_rows(spark):
    """Equal lengths match beside longer ones; shared ids, nulls and blocks; groups equal those of the pairs."""
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5 if k % 3 else 3)]) for k in range(120)]
    rows += [(200, [0.0] * 5), (201, None), (202, []), (203, [1.0, None, 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for more in ([], [(7, rows[9][1]), (7, rows[8][1])]):
        df = spark.createDataFrame([*rows, *more], "id int, v array<float>")
        good = [*rows[:120], *more]
        want = sorted((a, b) for a, x in good for b, y in good if a < b and len(x) == len(y) and dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 >= 0.5)
        for size in (11, 1000):
            pairs = similarity.similarity_pairs(df, "id", {"v": 1.0}, 0.5, size)
            assert sorted((r[0], r[1]) for r in pairs.collect()) == want
        serial = {(r["id"], r["leader"]) for r in similarity.greedy_groups(None, pairs, "id").collect()}
        for first in (3, 1000):
            got = similarity.similarity_groups(df, "id", {"v": 1.0}, 0.5, first, 20).collect()
            assert {(r["id"], r["leader"]) for r in got} == serial and len(got) == len(serial)
            assert all((r["similarity"] is None) == (r["id"] == r["leader"]) for r in got)


def test_similarity_shuffles_no_pairs(spark):
    df = spark.range(50).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    plan = similarity.similarity_pairs(df, "id", {"v": 1.0}, 0.5, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    blended = similarity.similarity_pairs(df.withColumn("w", F.reverse("v")), "id", {"v": 0.7, "w": 0.3}, 0.5, 7)
    assert "Exchange" not in blended._jdf.queryExecution().executedPlan().toString()


def test_scalars(spark):
    df = spark.createDataFrame([("a.b.c", "Klass", "Moved and renamed it\nmore", "x\ny\n", 11, 50.0), ("m", "fn", "Fix", "", None, 0.0), ("", "", None, None, 0, None)], "m string, n string, msg string, t string, c int, i double")
    rows = df.select(
        scalar.module_path("m"), scalar.node_type("n"), scalar.keyword_events("msg"), scalar.line_count("t"), scalar.risk_flag("c", "i"), scalar.undocumented("t"), scalar.first_line("msg"), scalar.progress(F.lit(1), F.lit(3)), scalar.progress(F.lit(1), F.lit(0)), scalar.threshold_of(F.lit("strict"))
    ).collect()
    assert [tuple(r)[:6] for r in rows] == [("a/b/c.py", "class", ["rename", "move"], 2, True, False), ("m.py", "function", [], 0, False, True), (".py", "function", [], None, False, True)]
    assert rows[0][6] == "Moved and renamed it" and rows[0][7] == 33 and rows[0][8] == 0 and rows[0][9] == 0.9
    e = df.select(scalar.excluded(F.lit("src/_x.py"), ["_*.py"]), scalar.excluded(F.lit("src/a.py"), ["^s.*y$"], "regex"), scalar.excluded(F.lit("src/a.py"), ["rc/"], "substring"), scalar.excluded(F.lit("a.py"), [])).first()
    assert tuple(e) == (True, True, True, False)
    with pytest.raises(ValueError):
        scalar.excluded("m", ["x"], "odd")


def test_sampling_and_numbering(spark):
    df = spark.range(103).withColumn("size", (F.col("id") * 37) % 101)
    n = relational.numbered(df, F.desc("id"), name="p")
    assert [(r["id"], r["p"]) for r in n.orderBy("p").collect()] == [(102 - k, k + 1) for k in range(103)]
    assert sorted(r["id"] for r in relational.sample(df, 10, "uniform", ["id"]).collect()) == list(range(0, 100, 10))
    assert relational.sample(df, 200, "odd", ["id"]).count() == 103 and relational.sample(df, 5, "all", ["id"]).count() == 5
    top = relational.sample(df, 3, "major", ["id"], F.col("size")).collect()
    assert [r["size"] for r in top] == sorted((r["size"] for r in df.collect()), reverse=True)[:3]
    with pytest.raises(ValueError):
        relational.sample(df, 0, "all", ["id"])


SNAPSHOTS = [(2, "abc123", "2024-01-01", "Author 1", ["file1"], 100, 0, "Start"), (1, "def456", "2024-01-02", "Author 2", ["file1", "file2"], 50, 10, "More"), (0, "ghi789", "2024-01-03", "Author 1", ["file1", "a.py -> b.py"], 20, 15, "Refactor it\nwell")]


def snapshots(spark):
    df = spark.createDataFrame(SNAPSHOTS, "ord int, hash string, d string, author string, files_changed array<string>, insertions int, deletions int, message string")
    return df.withColumn("timestamp", F.to_timestamp("d"))


def test_history(spark):
    c = snapshots(spark)
    assert {r["path"]: r["churn"] for r in history.file_churn(c).collect()} == {"file1": 3, "file2": 1}
    assert {r["author"]: r["commits"] for r in history.contributors(c).collect()} == {"Author 1": 2, "Author 2": 1}
    m = spark.createDataFrame([("abc123", "file1", 5), ("def456", "file1", 7), ("def456", "file2", 3), ("ghi789", "file1", 4), ("ghi789", "file3", None)], "commit string, path string, cyclomatic int")
    t = history.complexity_trends(c, m).collect()
    assert [(r["path"], r["n_points"], r["max_value"], r["min_value"], r["current_value"], r["direction"]) for r in t] == [("file1", 3, 7.0, 4.0, 4.0, "stable")]
    assert {r["hash"]: r["avg_complexity"] for r in history.average_complexity(c, m).collect()} == {"abc123": 5.0, "def456": 5.0, "ghi789": 4.0}
    ev = {(r["event_type"], r["confidence"], r["before_hash"]) for r in history.refactoring_events(c).collect()}
    assert ev == {("extract", 0.7, "def456"), ("rename", 1.0, "def456")}
    scores = [r["hash"] for r in relational.sample(c, 2, "major", [F.desc("ord")], F.col("insertions") + F.col("deletions"), "message").collect()]
    assert scores == ["abc123", "ghi789"]
    assert [r["hash"] for r in history.limited(c, 2, ".py").collect()] == ["ghi789"]
    assert history.find_commit(c, "de").first()["hash"] == "def456" and history.between(c, older="abc").count() == 2
    assert history.file_history(c, "b.py").count() == 1


def test_name_variants_and_flows(spark):
    df = spark.createDataFrame([("f", "h1", "a", 1), ("f", "h2", "b", 2), ("f", "h1", "c", 3), ("g", "h3", "a", 4)], "name string, h string, path string, o int")
    got = [(r["h"], r["path"], r["is_base"], r["base_hash"]) for r in relational.name_variants(df, "name", "h", "path", "o").orderBy("position").collect()]
    assert got == [("h1", "c", True, "h1"), ("h2", "b", False, "h1")]
    flows = {r["name"]: (r["definition_count"], r["usage_count"], r["is_orphan"], r["is_undefined"]) for r in relational.flow_counts(df, df.where("name = 'f'").union(df.limit(1).withColumn("name", F.lit("z"))), "name").collect()}
    assert flows == {"f": (3, 3, False, False), "g": (1, 0, True, False), "z": (0, 1, False, True)}
    stats = relational.duplicate_statistics(df.limit(0), "h", "o").first()
    assert stats["total_lines"] == 0 and stats["duplicate_percentage"] == 0.0
