"""Operators over commit history: events, churn, contributors, trends.

``commits`` has the columns of ``schemas.COMMITS``; ``ord`` 0 is the newest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import relational


def limited(commits: DataFrame, max_commits: int, file_suffix: str | None = None) -> DataFrame:
    """The newest ``max_commits``; then, with a suffix, their files that end so,
    commits without any left out."""
    newest = commits.orderBy("ord").limit(max_commits)
    if file_suffix is None:
        return newest
    kept = newest.withColumn("files_changed", F.filter("files_changed", lambda f: f.endswith(file_suffix)))
    return kept.where(F.size("files_changed") > 0)


def commit_files(commits: DataFrame) -> DataFrame:
    """One row a changed file: ``hash, ord, path, rename_from, rename_to``."""
    each = commits.select("hash", "ord", F.explode("files_changed").alias("path"))
    return each.withColumn("_r", scalar.renamed("path")).select("hash", "ord", "path", F.col("_r.old").alias("rename_from"), F.col("_r.new").alias("rename_to"))


def refactoring_events(commits: DataFrame) -> DataFrame:
    """Events told by the message (confidence 0.7) and renamed files (1.0); the
    oldest commit has none to compare with."""
    with_older = relational.next_older(commits, "hash", [F.col("ord")])
    told = relational.events_by_keyword(with_older, "message").select(
        "ord", F.col("hash").alias("commit_hash"), "event_type", F.array().cast("array<string>").alias("affected_definitions"), F.col("before").alias("before_hash"),
        F.col("hash").alias("after_hash"), F.lit(0.7).alias("confidence"), scalar.first_line("message").alias("description"),
    )
    moved = commit_files(with_older).where("rename_from is not null").join(with_older.select("hash", "before"), "hash")
    files = moved.select(
        "ord", F.col("hash").alias("commit_hash"), F.lit("rename").alias("event_type"), F.array("rename_from", "rename_to").alias("affected_definitions"), F.col("before").alias("before_hash"),
        F.col("hash").alias("after_hash"), F.lit(1.0).alias("confidence"), F.concat(F.lit("Renamed "), "rename_from", F.lit(" to "), "rename_to").alias("description"),
    )
    return told.unionByName(files)


def file_churn(commits: DataFrame) -> DataFrame:
    return relational.churn(commits.select(F.explode("files_changed").alias("path")), "path")


def file_hotspots(commits: DataFrame, k: int = 20) -> DataFrame:
    return relational.top_k(file_churn(commits), "churn", k, "path")


def contributors(commits: DataFrame) -> DataFrame:
    return relational.count_by(commits, "author", name="commits")


def average_complexity(commits: DataFrame, measured: DataFrame) -> DataFrame:
    """``ord, hash, timestamp, avg_complexity``; ``measured`` has ``commit, path,
    cyclomatic``.  Null where no file of the commit has a complexity."""
    per = measured.groupBy(F.col("commit").alias("hash")).agg(F.avg("cyclomatic").alias("avg_complexity"))
    return commits.join(per, "hash", "left").select("ord", "hash", "timestamp", "avg_complexity")


def complexity_trends(commits: DataFrame, measured: DataFrame) -> DataFrame:
    joined = measured.join(commits.select(F.col("hash").alias("commit"), "timestamp", "ord"), "commit")
    points = joined.withColumn("_age", -F.col("ord"))
    return relational.trends(points, "path", "timestamp", "cyclomatic", "_age")


def file_history(commits: DataFrame, path: str, max_commits: int = 50) -> DataFrame:
    """Commits that touch a path, newest first; files changed is the path alone."""
    touched = commits.where(F.exists("files_changed", lambda f: (f == path) | f.startswith(path + " -> ") | f.endswith(" -> " + path)))
    only = touched.withColumn("files_changed", F.array(F.lit(path))).withColumn("insertions", F.lit(0)).withColumn("deletions", F.lit(0))
    return only.orderBy("ord").limit(max_commits)


def find_commit(commits: DataFrame, prefix: str, newest: int = 1000) -> DataFrame:
    return commits.orderBy("ord").limit(newest).where(F.col("hash").startswith(prefix)).orderBy("ord").limit(1)


def between(commits: DataFrame, older: str | None = None, newer: str | None = None) -> DataFrame:
    """Commits after ``older`` up to and with ``newer`` (hash prefixes)."""
    out = commits
    if newer is not None:
        out = out.join(F.broadcast(find_commit(commits, newer).select(F.col("ord").alias("_n"))), F.col("ord") >= F.col("_n")).drop("_n")
    if older is not None:
        out = out.join(F.broadcast(find_commit(commits, older).select(F.col("ord").alias("_o"))), F.col("ord") < F.col("_o")).drop("_o")
    return out


def sampled(commits: DataFrame, most: int, strategy: str = "uniform") -> DataFrame:
    return relational.sample(commits, most, strategy, ["ord"], F.col("insertions") + F.col("deletions"), "message")
