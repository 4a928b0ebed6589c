"""Sources, analyses, sinks and the command line on real files."""

import json
import subprocess

import pytest

from plinth import api, cli
from plinth.operators import code, history
from plinth.plans import code_queries
from plinth.plans import project as plans
from plinth.sinks import export
from plinth.sources import git, pyfiles, store
from plinth.streaming import watch


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shop"
    (root / ".hidden").mkdir(parents=True)
    for path, text in code_queries.TREE:
        (root / path).write_text(text)
    (root / "_private.py").write_text("import shop\n")
    (root / "__init__.py").write_text("")
    (root / ".hidden" / "x.py").write_text("y = 1\n")
    return root


def test_every_file_is_listed(spark, tree):
    listed = {r["path"] for r in pyfiles.read_tree(spark, str(tree)).collect()}
    assert listed == {"shop.py", "prices.py", "broken.py", "_private.py", "__init__.py", ".hidden/x.py"}
    for exclude, dialect in ((["_*"], "glob"), ([r"^_"], "regex"), (["/_"], "substring")):
        assert not any(r["path"].startswith("_") for r in pyfiles.read_tree(spark, str(tree), exclude, dialect).collect())


def test_project_analysis(spark, tree):
    p = api.ProjectAnalyzer(spark, str(tree), ["__init__.py"])
    project = p.execute()
    assert {tuple(r) for r in project.import_edges.collect()} == {("shop.py", "prices.py"), ("prices.py", "shop.py"), ("_private.py", "shop.py")}
    assert {(r["src"], r["dst"]) for r in project.call_edges.collect()} == {("submit", "tally"), ("tally", "lookup"), ("sum_up", "lookup")}
    assert {r["name"] for r in project.orphans.collect()} == {"Basket", "__init__", "add", "spare", "submit", "sum_up"} - {"__init__"}
    doc = p.document()
    assert [f["path"] for f in doc["files"]] == [".hidden/x.py", "_private.py", "prices.py", "shop.py"] and set(doc["variants"]) == {"tally"}
    assert project.files.where("parse_error is not null").count() == 1
    assert '"shop.py" -> "prices.py";' in p.generate_dependency_graph() and "`Basket.add`" in p.generate_markdown()
    assert api.get_file(project, "shop.py").count() == 1
    with pytest.raises(LookupError):
        api.get_file(project, "none.py")
    frames = export.chart_frames(project, plans.analyze_variables(code_queries.sources(spark)))
    assert "call_graph" in export.dashboard_html(frames)


def test_variants_merge_and_patch(spark, tree):
    a = api.VariantAnalyzer(spark, str(tree))
    v = a.analyze(min_lines=3, threshold=0.8)
    assert v.groups.count() >= 2 and v.matches.where("similarity < 0.8").count() == 0
    s = v.statistics.first()
    assert s["total_blocks"] == v.blocks.count() and s["variant_blocks"] == v.groups.count()
    assert set(export.variants_document(v)) == {"exact_duplicates", "semantic_variants", "variant_matches", "merged_variants", "statistics"}
    before = (tree / "shop.py").read_text()
    paths = a.apply_merges(v)
    assert paths and (tree / "shop.py").read_text() == before
    a.apply_merges(v, dry_run=False)
    changed = [p for p in paths if (tree / p.split("/")[-1]).with_suffix(".py.bak").exists()]
    assert changed


def test_clone_pair_is_grouped(spark):
    body = "    result = []\n    for {v} in {p}:\n        if {v} > 0:\n            result.append({v} * 2)\n    return result\n"
    rows = [("module1.py", "def process_data(data):\n" + body.format(v="item", p="data")), ("module2.py", "def transform_items(items):\n" + body.format(v="x", p="items"))]
    v = plans.analyze_variants(spark.createDataFrame(rows, "path string, content string"), 3, 0.8)
    assert v.groups.count() == 2 and v.exact_duplicates.count() == 0 and v.pairs.first()["similarity"] >= 0.8


def test_variables_and_dependencies(spark, tree):
    v = plans.analyze_variables(code_queries.sources(spark))
    flow = {r["name"]: r for r in v.flows.collect()}
    assert flow["limit"]["usage_count"] == 1 and flow["unused"]["is_orphan"] and flow["ValueError"]["is_undefined"] and flow["total"]["is_redefined"]
    p = plans.analyze_sources(code_queries.sources(spark))
    d = api.DependencyAnalyzer(p, v).analyze()
    assert d.nodes.where("node_type = 'variable'").count() > 0 and d.cycles.count() == 0
    assert {r["node"] for r in d.leaf_nodes.collect()} >= {"lookup"} - {"lookup"}
    text = export.report_markdown(p, v, d)
    assert "## Orphaned variables" in text and "<h1" in export.to_html(text)


def run(repo, *args, date="2024-01-01T00:00:00Z"):
    env = {"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "HOME": str(repo), "PATH": "/usr/bin:/bin:/usr/local/bin"}
    subprocess.run(["git", "-c", "user.name=A", "-c", "user.email=a@x", "-c", "init.defaultBranch=main", "-C", str(repo), *args], check=True, capture_output=True, env=env)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run(root, "init")
    for k, (name, text, message) in enumerate([("a.py", "def f(x):\n    return x\n", "Start"), ("a.py", "def f(x):\n    if x:\n        return 1\n    return x\n", "Refactor f"), ("b.txt", "no code\n", "Note")]):
        (root / name).write_text(text)
        run(root, "add", "-A")
        run(root, "commit", "-m", message, date=f"2024-01-0{k + 1}T00:00:00Z")
    run(root, "mv", "a.py", "c.py")
    run(root, "commit", "-m", "Rename file", date="2024-01-09T00:00:00Z")
    return root


def test_git_history(spark, repo):
    g = api.GitAnalyzer(spark, str(repo))
    rows = g.get_commit_history().orderBy("ord").collect()
    assert [r["message"] for r in rows] == ["Rename file", "Note", "Refactor f", "Start"] and rows[0]["files_changed"] == ["a.py -> c.py"]
    assert rows[3]["files_changed"] == [] and rows[3]["insertions"] == 0 and (rows[2]["insertions"], rows[2]["deletions"]) == (2, 0) and rows[2]["short_hash"] == rows[2]["hash"][:7]
    ev = {(r["event_type"], r["confidence"]) for r in api.refactorings(g).collect()}
    assert ev == {("rename", 1.0), ("rename", 0.7), ("extract", 0.7)}
    state = g.state().first()
    assert state["branch"] == "main" and not state["is_dirty"] and state["remote_url"] is None
    texts = g.analyze_at_commit(rows[2]["hash"], code.files).collect()
    assert [(r["path"], r["metrics"]["cyclomatic"]) for r in texts] == [("a.py", 2)]
    assert api.get_commit(g, rows[1]["hash"][:9]).first()["message"] == "Note"
    with pytest.raises(LookupError):
        api.get_commit(g, "zzz")
    with pytest.raises(ValueError):
        api.timeline(g, 0)
    assert api.hotspots(g).collect() and history.commit_files(g.commits).where("rename_to = 'c.py'").count() == 1


def test_temporal_and_cache(spark, repo, tmp_path):
    t = api.TemporalAnalyzer(spark, str(repo), str(tmp_path / "cache"))
    assert t.get_cache_size() == 0
    out = t.analyze_evolution(10, "all")
    got = {r["path"]: (r["n_points"], r["max_value"], r["direction"]) for r in out.trends.collect()}
    assert got == {"a.py": (3, 2.0, "increasing")}
    assert t.get_cache_size() == 4 and t.analyze_evolution(10).timeline.count() == 4
    t.clear_cache()
    assert t.get_cache_size() == 0
    with pytest.raises(ValueError):
        t.analyze_evolution(0)


def test_command_line(tree, capsys, tmp_path, monkeypatch, spark):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["analyze", str(tree), "-o", str(tmp_path / "a.json"), "--markdown", str(tmp_path / "a.md"), "--graphviz", str(tmp_path / "a.dot")]) == 0
    assert json.loads((tmp_path / "a.json").read_text())["files"] and (tmp_path / "a.md").read_text() and (tmp_path / "a.dot").read_text().startswith("digraph")
    assert cli.main(["variants", str(tree), "-o", str(tmp_path / "v.json"), "--threshold", "0.7", "--min-lines", "3"]) == 0
    assert json.loads((tmp_path / "v.json").read_text())["statistics"]["total_blocks"] > 0
    assert cli.main(["compare", str(tree), str(tmp_path / "cmp")]) == 0 and (tmp_path / "cmp" / "summary.csv").exists()
    summary = store.read_summary(spark, str(tmp_path / "cmp" / "summary.csv")).collect()
    assert [r["name"] for r in summary] == ["tally"] and store.read_diffs(spark, str(tmp_path / "cmp" / "diffs")).first()["name"] == "tally"
    assert cli.main(["analyze", str(tmp_path / "none")]) == 2


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"path": p, "content": c}) for p, c in code_queries.TREE))
    got = []
    q = watch.analyze_stream(watch.file_stream(spark, str(tmp_path / "in")), lambda df, n: got.extend(r["name"] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert "Basket" in got and "lookup" in got
    e = spark.sql("select timestamp '2024-01-01 10:00:00' as ts, 'a' as k union all select timestamp '2024-01-01 12:00:00', 'a' union all select timestamp '2024-01-02 00:00:00', 'a'")
    assert sorted(r["churn"] for r in watch.activity(e, "ts", "k").collect()) == [1, 2]
