"""Driver queries over a small source tree of our own, and streams.

The driver's tables hold no source code or history, so these read the sources and
commits below.  SQL can't express parsing; their SQL is the rows that follow from
the sources by reading (``golden``).  Arrays are joined to text, for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth import schemas
from plinth.operators import code, dashboard, graph, history, similarity
from plinth.plans import project

SHOP = '''"""Order handling."""
import re
import os.path
import prices
from threading import Lock

RATE: float = 0.19
limit = 10
codes = [c for c in "abc" if c]


class Basket(object):
    """Goods before payment."""

    def __init__(self, owner):
        self.owner = owner
        self.items = []

    def add(self, item, n: int = 1) -> None:
        for _ in range(n):
            self.items.append(item)


async def submit(basket):
    if not basket.items:
        raise ValueError("empty")
    total = tally(basket.items)
    return total


def tally(values):
    """Sum of the prices."""
    result = 0
    for v in values:
        if v is not None and v > 0:
            result += prices.lookup(v)
    return result
'''
PRICES = '''import shop


def lookup(item):
    # one price for all
    try:
        return item * 2
    except TypeError:
        return 0


def sum_up(numbers):
    total = 10
    for n in numbers:
        if n is not None and n > 5:
            total += lookup(n)
    return total


def tally(values):
    return len(values)


def spare():
    unused = limit
    return {k: v for k, v in zip("ab", "cd")}
'''
BROKEN = "def half(:\n"
TREE = [("shop.py", SHOP), ("prices.py", PRICES), ("broken.py", BROKEN)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE, "path string, content string")


def flat(df: DataFrame, between: str = ",") -> DataFrame:
    """Arrays of plain values as text."""
    return df.select(*[F.array_join(F.col(n).cast("array<string>"), between).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes])


@query
def file_metadata(spark, d):
    files = code.files(sources(spark)).withColumn("parsed", F.col("parse_error").isNull())
    return flat(files.drop("definitions", "comprehension_patterns", "oop_patterns", "metrics", "parse_error"))


@query
def definitions(spark, d):
    return flat(code.definitions(code.files(sources(spark))).drop("metrics", "source_text", "source_hash"))


@query
def cyclomatic(spark, d):
    return code.definitions(code.files(sources(spark))).select("path", "ordinal", "name", "metrics.cyclomatic", "metrics.risk_flag")


@query
def maintainability(spark, d):
    return code.definitions(code.files(sources(spark))).select("path", "ordinal", "name", "metrics.maintainability_index")


@query
def import_edges(spark, d):
    return code.import_edges(code.files(sources(spark)))


@query
def code_name_variants(spark, d):
    return flat(code.name_variants(code.definitions(code.files(sources(spark)))).drop("source_hash", "refactor_prompt"), "\n")


@query
def code_blocks(spark, d):
    return code.blocks(sources(spark), 3).select("block_id", "path", "ordinal", "start_line", "end_line", "content", "hash")


@query
def normalized_code(spark, d):
    return code.blocks(sources(spark), 3).select("block_id", "normalized")


@query
def code_variant_groups(spark, d):
    b = code.blocks(sources(spark), 3)
    pairs = similarity.similarity_pairs(b, "block_id", {"embedding_normalized": 0.7, "embedding": 0.3}, 0.8)
    return similarity.greedy_groups(b, pairs, "block_id")


@query
def merged_variants(spark, d):
    merges = project.analyze_variants(sources(spark), min_lines=3, threshold=0.8).merges
    return flat(merges.select("leader", "base_block", "original_blocks", "affected_files", F.size("changes").alias("n_changes")))


@query
def unified_diff(spark, d):
    s = sources(spark).where("path <> 'broken.py'")
    return flat(s.agg(code.diff_lines(F.max("content"), F.min("content")).alias("diff")), "\n")


@query
def variable_rows(spark, d):
    return code.variables(sources(spark))


@query
def variable_flows(spark, d):
    return code.variable_flows(code.variables(sources(spark))).withColumn("definitions", F.size("definitions")).withColumn("usages", F.size("usages"))


@query
def variable_report(spark, d):
    return code.variable_report(code.variable_flows(code.variables(sources(spark))))


@query
def variable_dependencies(spark, d):
    return code.variable_dependencies(code.variables(sources(spark)))


@query
def call_graph(spark, d):
    return code.project_call_edges(code.definitions(code.files(sources(spark))))


@query
def call_levels(spark, d):
    return graph.dependency_levels(code.project_call_edges(code.definitions(code.files(sources(spark)))))


@query
def uncalled_definitions(spark, d):
    return code.uncalled(code.definitions(code.files(sources(spark)))).select("path", "name", "category")


@query
def project_dashboard(spark, d):
    files = code.files(sources(spark))
    defs = code.definitions(files)
    return dashboard.metrics(files, defs, code.uncalled(defs), code.name_variants(defs).select("name").distinct())


@query
def external_packages(spark, d):
    return dashboard.external_packages(code.files(sources(spark)).where("parse_error is null"))


HISTORY = [
    ("abc123", 1, "Author 1", "Initial commit", ["file1"], 100, 0, {"file1": 5}),
    ("def456", 2, "Author 2", "Refactor authentication module", ["file1", "file2"], 50, 10, {"file1": 7, "file2": 3}),
    ("ghi789", 3, "Author 1", "Add new feature\n\nand more", ["file1", "old_name.py -> new_name.py"], 20, 15, {"file1": 4}),
]


def commits(spark: SparkSession) -> DataFrame:
    """Three commits, the last the newest, of which one refactors and one renames a file."""
    import datetime as dt

    rows = [(len(HISTORY) - k - 1, h, h[:7], dt.datetime(2024, 1, day), who, "a@b", text, files, plus, minus) for k, (h, day, who, text, files, plus, minus, _) in enumerate(HISTORY)]
    return spark.createDataFrame(rows, schemas.COMMITS)


def measured(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, f, c) for h, *_, per in HISTORY for f, c in per.items()], "commit string, path string, cyclomatic int")


@query
def history_events(spark, d):
    return flat(history.refactoring_events(commits(spark)).withColumn("confidence", F.col("confidence").cast("double")))


@query
def history_churn(spark, d):
    return history.file_churn(commits(spark))


@query
def history_hotspots(spark, d):
    return history.file_hotspots(commits(spark), 1)


@query
def history_contributors(spark, d):
    return history.contributors(commits(spark))


@query
def history_timeline(spark, d):
    return history.average_complexity(commits(spark), measured(spark)).select("ord", "hash", "avg_complexity")


@query
def history_trends(spark, d):
    return history.complexity_trends(commits(spark), measured(spark))


@query
def history_of_a_file(spark, d):
    return flat(history.file_history(commits(spark), "new_name.py").select("hash", "files_changed", "insertions", "deletions"))


@query
def history_limited(spark, d):
    return flat(history.limited(commits(spark), 2, "file2").select("hash", "files_changed"))


@query
def history_renames(spark, d):
    return history.commit_files(commits(spark)).where("rename_from is not null").select("hash", "rename_from", "rename_to")


@query
def history_major(spark, d):
    return history.sampled(commits(spark), 2, "major").select("hash", "score")


@query
def history_uniform(spark, d):
    return history.sampled(commits(spark), 2, "uniform").select("hash")


@query
def history_between(spark, d):
    return history.between(commits(spark), "abc", "def").select("hash")


@query
def patched_files(spark, d):
    """Every file once, with all merges that touch it."""
    merges = project.analyze_variants(sources(spark), min_lines=3, threshold=0.8).merges
    return project.patched_files(sources(spark), merges).select("path")


@query
def variable_users(spark, d):
    rows = code.variables(sources(spark))
    return code.variable_users(rows, code.definitions(code.files(sources(spark))).select("name"))


@query
def class_edges(spark, d):
    return code.class_edges(code.definitions(code.files(sources(spark))))


@query
def lines_per_file(spark, d):
    return dashboard.lines_per_file(code.definitions(code.files(sources(spark))))


@query
def most_called(spark, d):
    return dashboard.most_called(code.project_call_edges(code.definitions(code.files(sources(spark)))), 1)


@query
def documentation(spark, d):
    return dashboard.documentation(code.definitions(code.files(sources(spark))))


@query
def undocumented_definitions(spark, d):
    return dashboard.undocumented(code.definitions(code.files(sources(spark))), 4)


@query
def multi_defined_names(spark, d):
    return dashboard.multi_defined(code.variable_flows(code.variables(sources(spark))), 3)


from plinth.plans.golden import ORACLE_SQL  # noqa: E402, F401
