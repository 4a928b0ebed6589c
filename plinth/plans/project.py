"""Whole analyses: from sources or a repository to bundles of lazy relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import code, graph, history, relational, similarity
from plinth.parse import normalize
from plinth.sources import git, pyfiles
from plinth.sources.store import CommitCache


@dataclass
class Project:
    files: DataFrame
    definitions: DataFrame
    import_edges: DataFrame
    name_variants: DataFrame
    call_edges: DataFrame
    orphans: DataFrame


@dataclass
class Variants:
    blocks: DataFrame
    exact_duplicates: DataFrame
    pairs: DataFrame
    groups: DataFrame
    matches: DataFrame
    merges: DataFrame
    statistics: DataFrame


@dataclass
class Variables:
    rows: DataFrame
    flows: DataFrame
    dependencies: DataFrame
    report: DataFrame


@dataclass
class Dependencies:
    nodes: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    leaf_nodes: DataFrame
    cycles: DataFrame
    components: DataFrame
    order: DataFrame
    levels: DataFrame


@dataclass
class Temporal:
    commits: DataFrame
    events: DataFrame
    churn: DataFrame
    hotspots: DataFrame
    contributors: DataFrame
    timeline: DataFrame
    trends: DataFrame


def analyze_sources(sources: DataFrame) -> Project:
    files = code.files(sources).persist(StorageLevel.MEMORY_AND_DISK)
    defs = code.definitions(files)
    return Project(files, defs, code.import_edges(files), code.name_variants(defs), code.project_call_edges(defs), code.uncalled(defs))


def analyze_project(spark: SparkSession, root: str, exclude: list[str] | None = None, dialect: str = "glob") -> Project:
    return analyze_sources(pyfiles.read_tree(spark, root, exclude, dialect))


def merge_groups(members: DataFrame) -> DataFrame:
    """One merged text a group of ``leader, block_id, path, content``: the base is
    the member with most syntax nodes, ``changes`` the diff of each other one."""

    schema = "leader bigint, base_block bigint, merged_content string, original_blocks array<bigint>, affected_files array<string>, changes array<struct<file:string,original:string,replacement:string,diff:array<string>>>"

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block_id").to_pylist()
        try:
            base, text = normalize.merge_sources([r["content"] for r in rows])
        except (SyntaxError, ValueError):  # methods cut out of a class, say: a group that can't be merged
            rows = []
        out = []
        if rows:
            changes = [
                {"file": r["path"], "original": r["content"], "replacement": text, "diff": normalize.unified_diff(r["content"], text)} for k, r in enumerate(rows) if k != base
            ]
            out = [{"leader": rows[0]["leader"], "base_block": rows[base]["block_id"], "merged_content": text, "original_blocks": [r["block_id"] for r in rows], "affected_files": sorted({r["path"] for r in rows}), "changes": changes}]
        strings = pa.list_(pa.string())
        change = pa.struct([("file", pa.string()), ("original", pa.string()), ("replacement", pa.string()), ("diff", strings)])
        return pa.Table.from_pylist(out, schema=pa.schema([("leader", pa.int64()), ("base_block", pa.int64()), ("merged_content", pa.string()), ("original_blocks", pa.list_(pa.int64())), ("affected_files", strings), ("changes", pa.list_(change))]))

    return members.select("leader", "block_id", "path", "content").groupBy("leader").applyInArrow(merge, schema)


def patched_files(sources: DataFrame, merges: DataFrame) -> DataFrame:
    """``path, content`` of the files that merges change, all changes of a file folded."""
    changes = merges.select("leader", F.explode("changes").alias("c")).select("leader", F.col("c.file").alias("path"), "c.original", "c.replacement")
    per_file = changes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("leader", "original", "replacement"))).alias("cs"))
    folded = F.aggregate("cs", F.col("content"), lambda text, c: F.replace(text, c["original"], c["replacement"]))
    return sources.join(per_file, "path").select("path", folded.alias("content"))


def analyze_variants(sources: DataFrame, min_lines: int = 5, threshold: float = 0.8, exclude: list[str] | None = None, embed: Callable[[str], list[float]] | None = None) -> Variants:
    if exclude:
        sources = sources.where(~scalar.excluded("path", exclude, "substring"))
    blocks = code.blocks(sources, min_lines, embed).persist(StorageLevel.MEMORY_AND_DISK)
    weights = {"embedding_normalized": 0.7, "embedding": 0.3}
    pairs = similarity.similarity_pairs(blocks, "block_id", weights, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    groups = similarity.greedy_groups(blocks, pairs, "block_id")
    place = ["block_id", "path", "start_line", "end_line", "content"]
    a, b = (blocks.select(*[F.col(c).alias(c if c == "block_id" else f"{c}_{s}") for c in place]).withColumnRenamed("block_id", f"id_{s}") for s in ("a", "b"))
    matches = pairs.join(a, "id_a").join(b, "id_b").withColumn("diff", code.diff_lines("content_a", "content_b"))
    members = groups.join(blocks.select("block_id", "path", "content", (F.col("end_line") - F.col("start_line") + 1).alias("lines")), "block_id")
    sized = blocks.withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    stats = relational.duplicate_statistics(sized, "hash", "lines", members.select(F.col("leader").alias("group_id"), "lines"))
    return Variants(blocks, relational.exact_duplicates(blocks, "content", "block_id"), pairs, groups, matches, merge_groups(members), stats)


def analyze_variables(sources: DataFrame, compat: bool = False) -> Variables:
    rows = code.variables(sources, compat).persist(StorageLevel.MEMORY_AND_DISK)
    flows = code.variable_flows(rows)
    return Variables(rows, flows, code.variable_dependencies(rows), code.variable_report(flows))


def analyze_dependencies(call_edges: DataFrame, variable_edges: DataFrame | None = None, max_cycle: int = 64) -> Dependencies:
    edges = call_edges if variable_edges is None else call_edges.unionByName(variable_edges).distinct()
    own = graph.nodes(call_edges).select(F.col("node").alias("name")).withColumn("node_type", scalar.node_type("name"))
    if variable_edges is not None:
        extra = graph.nodes(variable_edges).select(F.col("node").alias("name")).join(own.select("name"), "name", "left_anti").withColumn("node_type", F.lit("variable"))
        own = own.unionByName(extra)
    nodes = own.join(graph.degrees(edges).withColumnRenamed("node", "name"), "name", "left")
    return Dependencies(
        nodes, edges, graph.entry_points(edges), graph.leaf_nodes(edges), graph.cycles(edges, max_cycle), graph.strongly_connected(edges), graph.initialization_order(edges), graph.dependency_levels(edges)
    )


def measured_files(commits: DataFrame, repo: str, cache: CommitCache | None = None) -> DataFrame:
    """``commit, path, cyclomatic``: each distinct blob is parsed once."""
    wanted = commits if cache is None else cache.missing(commits)
    files = git.snapshot_files(wanted, repo)
    parsed = code.files(git.blobs(files, repo)).select(F.col("path").alias("blob"), F.col("metrics.cyclomatic").alias("cyclomatic"))
    fresh = files.join(parsed, "blob").select("commit", "path", "cyclomatic")
    if cache is None:
        return fresh
    cache.write(fresh)
    return cache.read().join(commits.select(F.col("hash").alias("commit")), "commit", "left_semi")


def analyze_history(spark: SparkSession, repo: str, max_commits: int = 100, strategy: str = "uniform", branch: str = "HEAD", commit_range: tuple[str | None, str | None] | None = None, cache: str | None = None) -> Temporal:
    if not 1 <= max_commits <= 1000:
        raise ValueError("max_commits must be between 1 and 1000")
    every = git.commits(spark, repo, branch).persist(StorageLevel.MEMORY_AND_DISK)
    if commit_range:
        every = history.between(every, *commit_range)
    chosen = history.sampled(every, max_commits, strategy)
    measured = measured_files(chosen, repo, CommitCache(spark, cache) if cache else None).persist(StorageLevel.MEMORY_AND_DISK)
    return Temporal(
        chosen, history.refactoring_events(every), history.file_churn(every), history.file_hotspots(every), history.contributors(every), history.average_complexity(chosen, measured), history.complexity_trends(chosen, measured)
    )


