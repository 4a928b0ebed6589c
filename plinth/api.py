"""Facade: the analyses as classes and the service's queries as functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import code, graph, history
from plinth.plans import project as plans
from plinth.sinks import export
from plinth.sources import git, pyfiles, store


class ProjectAnalyzer:
    def __init__(self, spark: SparkSession, root: str, exclude: list[str] | None = None, dialect: str = "glob"):
        self.spark, self.root, self.exclude, self.dialect = spark, root, exclude, dialect
        self._project: plans.Project | None = None

    def execute(self) -> plans.Project:
        if self._project is None:
            self._project = plans.analyze_project(self.spark, self.root, self.exclude, self.dialect)
        return self._project

    analyze = execute

    def document(self) -> dict:
        return export.project_document(self.execute())

    def generate_markdown(self) -> str:
        return export.summary_markdown(self.execute())

    def generate_dependency_graph(self) -> str:
        return export.dot(self.execute().import_edges)


class VariantAnalyzer:
    def __init__(self, spark: SparkSession, root: str, exclude: list[str] | None = None, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.root, self.exclude, self.embed = spark, root, exclude, embed

    def analyze(self, min_lines: int = 5, threshold: float = 0.8) -> plans.Variants:
        sources = pyfiles.read_tree(self.spark, self.root, self.exclude, "substring")
        return plans.analyze_variants(sources, min_lines, threshold, embed=self.embed)

    def apply_merges(self, variants: plans.Variants, backup: bool = True, dry_run: bool = True) -> list[str]:
        sources = pyfiles.read_tree(self.spark, self.root, self.exclude, "substring")
        return export.write_patches(plans.patched_files(sources, variants.merges), self.root, backup, dry_run)


class VariableAnalyzer:
    def __init__(self, spark: SparkSession, root: str, exclude: list[str] | None = None, compat: bool = False):
        self.sources, self.compat = pyfiles.read_tree(spark, root, exclude, "regex"), compat

    def analyze(self) -> plans.Variables:
        return plans.analyze_variables(self.sources, self.compat)


class DependencyAnalyzer:
    def __init__(self, project: plans.Project, variables: plans.Variables | None = None):
        self.project, self.variables = project, variables

    def analyze(self, max_cycle: int = 64) -> plans.Dependencies:
        extra = None
        if self.variables is not None:
            extra = code.variable_users(self.variables.rows, self.project.definitions.select("name")).unionByName(self.variables.dependencies).distinct()
        return plans.analyze_dependencies(self.project.call_edges, extra, max_cycle)


class GitAnalyzer:
    def __init__(self, spark: SparkSession, repo: str, branch: str = "HEAD"):
        self.spark, self.repo = spark, repo
        self.commits = git.commits(spark, repo, branch).cache()

    def get_commit_history(self, max_commits: int = 100, file_suffix: str | None = None) -> DataFrame:
        return history.limited(self.commits, max_commits, file_suffix)

    def get_file_history(self, path: str, max_commits: int = 50) -> DataFrame:
        return history.file_history(self.commits, path, max_commits)

    def detect_refactoring_events(self, max_commits: int = 50) -> DataFrame:
        return history.refactoring_events(history.limited(self.commits, max_commits))

    def analyze_at_commit(self, commit: str, analyze: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        return git.analyze_at(self.spark, self.repo, commit, analyze)

    def state(self) -> DataFrame:
        return git.state(self.spark, self.repo)


class TemporalAnalyzer:
    def __init__(self, spark: SparkSession, repo: str, cache: str | None = None):
        self.spark, self.repo, self.cache = spark, repo, cache

    def analyze_evolution(self, max_commits: int = 100, strategy: str = "uniform", **kw) -> plans.Temporal:
        return plans.analyze_history(self.spark, self.repo, max_commits, strategy, cache=self.cache, **kw)

    def get_cache_size(self) -> int:
        return store.CommitCache(self.spark, self.cache).size() if self.cache else 0

    def clear_cache(self) -> None:
        if self.cache:
            store.CommitCache(self.spark, self.cache).clear()


# What the service's endpoints answer, as queries on a project or a history.


def _between(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def list_files(p: plans.Project) -> DataFrame:
    return p.files.select("path", "comment_count", "branch_count", "loop_count", "metrics", "parse_error").orderBy("path")


def get_file(p: plans.Project, path: str) -> DataFrame:
    found = p.files.where(F.col("path") == path)
    if found.isEmpty():
        raise LookupError(path)
    return found


def dependency_graph(p: plans.Project) -> tuple[DataFrame, DataFrame]:
    links = graph.clean(p.import_edges)
    return p.files.select(F.col("path").alias("id")).distinct(), links


def variant_groups(v: plans.Variants) -> DataFrame:
    from plinth.operators.similarity import group_similarity

    return group_similarity(v.groups, v.pairs, "block_id")


def commits(g: GitAnalyzer, max_commits: int = 100) -> DataFrame:
    return g.get_commit_history(_between(max_commits, 1, 500, "max_commits"))


def timeline(g: GitAnalyzer, max_commits: int = 100) -> DataFrame:
    shown = g.get_commit_history(_between(max_commits, 1, 1000, "max_commits"))
    return shown.select("hash", "short_hash", "timestamp", "author", scalar.first_line("message").alias("subject"), F.size("files_changed").alias("n_files"), "insertions", "deletions")


def get_commit(g: GitAnalyzer, prefix: str) -> DataFrame:
    found = history.find_commit(g.commits, prefix)
    if found.isEmpty():
        raise LookupError(prefix)
    return found


def complexity_evolution(t: TemporalAnalyzer, max_commits: int = 50, strategy: str = "uniform") -> DataFrame:
    if strategy not in ("uniform", "major", "all"):
        raise ValueError("strategy must be uniform, major or all")
    return t.analyze_evolution(_between(max_commits, 5, 200, "max_commits"), strategy).trends


def refactorings(g: GitAnalyzer, max_commits: int = 50) -> DataFrame:
    return g.detect_refactoring_events(_between(max_commits, 1, 200, "max_commits"))


def hotspots(g: GitAnalyzer, max_commits: int = 100, k: int = 20) -> DataFrame:
    return history.file_hotspots(g.get_commit_history(_between(max_commits, 1, 500, "max_commits")), k)


def health() -> dict:
    return {"status": "healthy"}
