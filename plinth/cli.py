"""Command line: analyze, variants, compare, history, report.

    python -m plinth.cli analyze DIR [-o FILE] [--markdown FILE] [--graphviz FILE] [--exclude GLOB ...]
    python -m plinth.cli variants DIR [-o FILE] [--threshold T | --profile P] [--min-lines N] [--apply [--no-backup]]
    python -m plinth.cli compare DIR OUT
    python -m plinth.cli history DIR [--max-commits N] [--strategy uniform|major|all]
    python -m plinth.cli report DIR FILE.md|FILE.html
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from plinth import api
from plinth.functions.scalar import PROFILES
from plinth.sinks import export


def session() -> SparkSession:
    builder = SparkSession.builder.appName("plinth").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plinth")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("root"), a.add_argument("-o", "--output", default="-"), a.add_argument("--markdown"), a.add_argument("--graphviz"), a.add_argument("--exclude", nargs="*", default=[]), a.add_argument("--indent", type=int, default=2)
    v = sub.add_parser("variants")
    v.add_argument("root"), v.add_argument("-o", "--output", default="-"), v.add_argument("--threshold", type=float, default=0.8), v.add_argument("--profile", choices=sorted(PROFILES)), v.add_argument("--min-lines", type=int, default=5)
    v.add_argument("--exclude", nargs="*", default=[]), v.add_argument("--apply", action="store_true"), v.add_argument("--no-backup", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("root"), c.add_argument("output")
    h = sub.add_parser("history")
    h.add_argument("root"), h.add_argument("--max-commits", type=int, default=20), h.add_argument("--strategy", default="uniform")
    r = sub.add_parser("report")
    r.add_argument("root"), r.add_argument("output")
    return p


def emit(document: dict, output: str, indent: int = 2) -> None:
    if output == "-":
        print(json.dumps(document, indent=indent, ensure_ascii=False))
    else:
        export.write_json(document, output, indent)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not Path(args.root).is_dir():
        print(f"{args.root} is not a directory", file=sys.stderr)
        return 2
    spark = session()
    if args.command == "analyze":
        p = api.ProjectAnalyzer(spark, args.root, args.exclude)
        emit(p.document(), args.output, args.indent)
        if args.markdown:
            Path(args.markdown).write_text(p.generate_markdown(), encoding="utf-8")
        if args.graphviz:
            Path(args.graphviz).write_text(p.generate_dependency_graph(), encoding="utf-8")
    elif args.command == "variants":
        a = api.VariantAnalyzer(spark, args.root, args.exclude)
        v = a.analyze(args.min_lines, PROFILES[args.profile] if args.profile else args.threshold)
        emit(export.variants_document(v), args.output)
        if args.apply:
            a.apply_merges(v, backup=not args.no_backup, dry_run=False)
    elif args.command == "compare":
        export.variant_comparison(args.output, api.ProjectAnalyzer(spark, args.root).execute())
    elif args.command == "history":
        t = api.TemporalAnalyzer(spark, args.root).analyze_evolution(args.max_commits, args.strategy)
        emit({k: export.rows(getattr(t, k)) for k in ("commits", "events", "hotspots", "contributors", "timeline", "trends")}, "-")
    else:
        p, v = api.ProjectAnalyzer(spark, args.root).execute(), api.VariableAnalyzer(spark, args.root).analyze()
        text = export.report_markdown(p, v, api.DependencyAnalyzer(p).analyze())
        Path(args.output).write_text(export.to_html(text) if args.output.endswith(".html") else text, encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
