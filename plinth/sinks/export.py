"""Reports of an analysis as files.

Each writer collects the small result that it prints (a report, not the data);
``write_table`` is for relations of any size.
"""

from __future__ import annotations

import csv
import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import code, dashboard, graph
from plinth.plans.project import Dependencies, Project, Variables, Variants


def write_table(df: DataFrame, folder: str, format: str = "parquet", partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").format(format)
    (writer.partitionBy(partition_by) if partition_by else writer).save(str(folder))


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def project_document(p: Project) -> dict:
    variants: dict[str, dict] = {}
    for r in rows(p.name_variants.orderBy("name", "position")):
        v = variants.setdefault(r["name"], {"implementations": [], "refactor_prompt": r["refactor_prompt"]})
        v["implementations"].append({"hash": r["source_hash"], "path": r["path"], "diff_from_base": r["diff_from_base"]})
    edges = [[r["src"], r["dst"]] for r in p.import_edges.orderBy("src", "dst").collect()]
    return {"files": rows(code.parsed(p.files).drop("parse_error").orderBy("path")), "variants": variants, "dependencies": edges}


def variants_document(v: Variants) -> dict:
    return {
        "exact_duplicates": rows(v.exact_duplicates.orderBy("hash")), "semantic_variants": rows(v.groups.orderBy("leader", "block_id")), "variant_matches": rows(v.matches.drop("content_a", "content_b").orderBy("id_a", "id_b")),
        "merged_variants": rows(v.merges.orderBy("leader")), "statistics": rows(v.statistics)[0],
    }


def write_json(document: dict, path: str, indent: int = 2) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=indent, ensure_ascii=False), encoding="utf-8")


def dot(edges: DataFrame, name: str = "dependencies", position: str | None = None) -> str:
    """Graphviz text of ``src, dst``."""
    lines = [r[0] for r in edges.select(F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')).alias("l")).orderBy("l").collect()]
    return "\n".join([f"digraph {name} {{", *lines, "}"]) + "\n"


def sequence_dot(order: DataFrame) -> str:
    return dot(graph.sequence_edges(order), "sequence")


def summary_markdown(p: Project) -> str:
    """Files with maintainability and complexity, and their definitions."""
    defs: dict[str, list] = {}
    for d in p.definitions.orderBy("path", "ordinal").select("path", "name", "category", "line_count", "metrics").collect():
        defs.setdefault(d["path"], []).append(d)
    out = ["# Code summary", ""]
    for f in code.parsed(p.files).orderBy("path").select("path", "metrics").collect():
        m = f["metrics"]
        out += [f"## {f['path']}", "", f"Maintainability {m['maintainability_index']:.1f}, complexity {m['cyclomatic'] if m['cyclomatic'] is not None else '-'}", ""]
        out += [f"- {d['category']} `{d['name']}`, {d['line_count']} lines" + (" ⚠" if d["metrics"]["risk_flag"] else "") for d in defs.get(f["path"], [])] + [""]
    return "\n".join(out)


def _table(title: str, df: DataFrame, columns: list[str]) -> list[str]:
    found = df.select(*columns).collect()
    body = ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in found]
    return [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *body, ""] if found else [f"## {title}", "", "None.", ""]


def _first(title: str, items: list[str], k: int) -> list[str]:
    more = [f"- … and {len(items) - k} more"] if len(items) > k else []
    return [f"## {title} ({len(items)})", "", *[f"- {x}" for x in items[:k]], *more, ""]


def report_markdown(p: Project, variables: Variables | None = None, dependencies: Dependencies | None = None) -> str:
    m = dashboard.metrics(p.files, p.definitions, p.orphans, p.name_variants.select("name").distinct())
    out = ["# Project report", "", *_table("Overview", m, m.columns)]
    out += _table("Most called", dashboard.most_called(p.call_edges), ["name", "callers"]) + _table("Most calling", dashboard.most_calling(p.call_edges), ["name", "callees"])
    out += _table("High complexity", dashboard.high_complexity(p.definitions), ["path", "name", "complexity"])
    out += _table("Undocumented", dashboard.undocumented(p.definitions), ["path", "name", "category"])
    out += _table("External packages", dashboard.external_packages(code.parsed(p.files)), ["package", "imports"])
    out += _first("Uncalled definitions", [f"{r['path']}: {r['name']}" for r in p.orphans.orderBy("path", "name").collect()], 20)
    if variables is not None:
        out += _table("Variables defined more than once", dashboard.multi_defined(variables.flows), ["name", "definition_count", "usage_count"])
        out += _first("Orphaned variables", [r["name"] for r in variables.flows.where("is_orphan").orderBy("name").collect()], 20)
    if dependencies is not None:
        out += _first("Initialization order", [r["node"] for r in dependencies.order.orderBy("position").collect()], 20)
        out += _first("Cycles", [" → ".join(map(str, r["cycle"])) for r in dependencies.cycles.orderBy("length", "cycle").collect()], 10)
    return "\n".join(out)


def to_html(markdown: str, title: str = "Report") -> str:
    """Headings, lists, tables and inline code, with a table of contents."""
    toc, body, in_list, in_table = [], [], False, False
    inline = lambda s: re.sub(r"`([^`]*)`", r"<code>\1</code>", html.escape(s))
    for line in [*markdown.splitlines(), ""]:
        if in_list and not line.startswith("- "):
            body.append("</ul>")
            in_list = False
        if in_table and not line.startswith("|"):
            body.append("</table>")
            in_table = False
        if match := re.match(r"(#+) (.*)", line):
            level, text = len(match[1]), match[2]
            anchor = re.sub(r"\W+", "-", text.lower()).strip("-")
            toc.append(f'<li><a href="#{anchor}">{inline(text)}</a></li>')
            body.append(f'<h{level} id="{anchor}">{inline(text)}</h{level}>')
        elif line.startswith("- "):
            body += ([] if in_list else ["<ul>"]) + [f"<li>{inline(line[2:])}</li>"]
            in_list = True
        elif line.startswith("|"):
            if not re.fullmatch(r"[|\- ]+", line):
                cells = "".join(f"<td>{inline(c.strip())}</td>" for c in line.strip("|").split("|"))
                body += ([] if in_table else ["<table>"]) + [f"<tr>{cells}</tr>"]
                in_table = True
        elif line:
            body.append(f"<p>{inline(line)}</p>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><nav><ul>{''.join(toc)}</ul></nav>\n" + "\n".join(body) + "\n</body></html>\n"


def chart_frames(p: Project, variables: Variables | None = None) -> dict[str, DataFrame]:
    """The data behind charts: call graph, hierarchy, heat map, variables, orphans, lines."""
    out = {
        "call_graph": p.call_edges, "centrality": graph.degree_centrality(p.call_edges), "class_hierarchy": code.class_edges(p.definitions), "import_heat_map": dashboard.heat_map(p.import_edges),
        "complexity": dashboard.high_complexity(p.definitions), "lines": dashboard.lines_per_file(p.definitions), "documentation": dashboard.documentation(p.definitions),
    }
    if variables is not None:
        out["variables"] = variables.flows.orderBy("name").select("name", "definition_count", "usage_count").limit(30)
        out["orphans"] = dashboard.orphan_kinds(p.orphans, variables.flows.where("is_orphan"))
    return out


def dashboard_html(frames: dict[str, DataFrame], title: str = "Dashboard") -> str:
    """A static page with each frame as a table and as JSON."""
    parts = []
    for name, df in frames.items():
        data = rows(df)
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c)))}</td>" for c in df.columns) + "</tr>" for r in data)
        parts.append(f"<section id='{name}'><h2>{name}</h2><table><tr>{head}</tr>{body}</table><script type='application/json'>{json.dumps(data).replace('</', '<\\/')}</script></section>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>\n"


def variant_comparison(folder: str, p: Project) -> list[str]:
    """A summary CSV (name, variants, risk, similarity), and a JSON file a name."""
    import difflib

    out = Path(folder)
    (out / "diffs").mkdir(parents=True, exist_ok=True)
    texts = {r["source_hash"]: r["source_text"] for r in p.definitions.select("source_hash", "source_text").distinct().collect()}
    document = project_document(p)["variants"]
    with (out / "summary.csv").open("w", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(["name", "variants", "risk_level", "similarity"])
        for name, v in sorted(document.items()):
            hashes = [i["hash"] for i in v["implementations"]]
            likeness = min(difflib.SequenceMatcher(None, texts[hashes[0]], texts[h]).ratio() for h in hashes[1:])
            writer.writerow([name, len(hashes), "high" if likeness < 0.5 else "medium" if likeness < 0.8 else "low", f"{likeness:.4f}"])
            (out / "diffs" / f"{re.sub(r'[^\w.]', '_', name)}.json").write_text(json.dumps(v, indent=2))
    return sorted(document)


def write_merged(folder: str, v: Variants) -> list[str]:
    """One Python file a merged group."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    names = []
    for r in v.merges.select("leader", "merged_content").orderBy("leader").collect():
        names.append(f"group_{r['leader']}.py")
        (out / names[-1]).write_text(r["merged_content"] + "\n")
    return names


def write_patches(patched: DataFrame, root: str, backup: bool = True, dry_run: bool = True) -> list[str]:
    """Write ``path, content`` under ``root``; old texts go to ``<name>.bak`` and
    come back where a write fails.  Dry by default: only the paths are returned."""
    done = []
    for r in patched.select("path", "content").orderBy("path").toLocalIterator():
        path = Path(root) / r["path"]
        done.append(str(path))
        if dry_run:
            continue
        old = path.read_text(encoding="utf-8")
        spare = path.with_suffix(path.suffix + ".bak")
        if backup:
            spare.write_text(old, encoding="utf-8")
        try:
            path.write_text(r["content"], encoding="utf-8")
        except OSError:
            path.write_text(old, encoding="utf-8")
            raise
    return done
