"""Aggregates behind reports and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import scalar
from plinth.operators import graph, relational


def metrics(files: DataFrame, defs: DataFrame, orphan_count: int | DataFrame = 0, variant_count: int | DataFrame = 0) -> DataFrame:
    """One row: files, functions, classes, methods, mean complexity, documented share, orphans, variants."""
    d = defs.agg(
        F.count_if(F.col("category") == "function").alias("functions"),
        F.count_if(F.col("category") == "class").alias("classes"),
        F.count_if(F.col("category") == "method").alias("methods"),
        F.avg("metrics.cyclomatic").alias("avg_complexity"),
        (F.count_if(~scalar.undocumented("docstring")) / F.when(F.count("*") > 0, F.count("*"))).alias("documented_share"),
    )
    one = lambda x, n: x.agg(F.count("*").alias(n)) if isinstance(x, DataFrame) else d.sparkSession.range(1).select(F.lit(x).alias(n))
    return files.agg(F.count("*").alias("files")).crossJoin(d).crossJoin(one(orphan_count, "orphans")).crossJoin(one(variant_count, "variants"))


def documentation(defs: DataFrame) -> DataFrame:
    return defs.agg(F.count_if(~scalar.undocumented("docstring")).alias("documented"), F.count_if(scalar.undocumented("docstring")).alias("undocumented"))


def undocumented(defs: DataFrame, k: int = 20) -> DataFrame:
    return defs.where(scalar.undocumented("docstring")).select("path", "name", "category", "start_line").orderBy("path", "start_line", "name", "category").limit(k)


def high_complexity(defs: DataFrame, k: int = 10, above: int = 10) -> DataFrame:
    c = defs.select("path", "name", "category", "start_line", F.col("metrics.cyclomatic").alias("complexity")).where(F.col("complexity") > above)
    return c.withColumn("radius", scalar.bubble_radius("complexity")).orderBy(F.desc("complexity"), "path", "start_line", "category").limit(k)


def lines_per_file(defs: DataFrame) -> DataFrame:
    return defs.groupBy("path").agg(F.sum("line_count").alias("lines"))


def most_called(edges: DataFrame, k: int = 10) -> DataFrame:
    return relational.top_k(graph.clean(edges).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("callers")), "callers", k, "name")


def most_calling(edges: DataFrame, k: int = 10) -> DataFrame:
    return relational.top_k(graph.clean(edges).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("callees")), "callees", k, "name")


def most_referenced(edges: DataFrame, k: int = 10) -> DataFrame:
    return relational.top_k(graph.clean(edges).groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("refs")), "refs", k, "module")


def external_packages(files: DataFrame, k: int = 10) -> DataFrame:
    """Packages imported from outside the project and the standard library."""
    own = files.select(F.substring_index(F.regexp_replace("path", r"\.py$", ""), "/", 1).alias("package")).distinct()
    used = files.select(F.explode(F.array_except("imports", "stdlib_imports")).alias("m")).where("m <> ''").select(F.substring_index("m", ".", 1).alias("package"))
    return relational.top_k(relational.count_by(used.join(own, "package", "left_anti"), "package", name="imports"), "imports", k, "package")


def multi_defined(flows: DataFrame, k: int = 15) -> DataFrame:
    return relational.top_k(flows.where("definition_count > 1").select("name", "definition_count", "usage_count"), "definition_count", k, "name")


def orphan_kinds(orphan_defs: DataFrame, orphan_variables: DataFrame) -> DataFrame:
    kinds = orphan_defs.select(F.col("category").alias("kind")).union(orphan_variables.select(F.lit("variable")))
    return relational.count_by(kinds, "kind")


def heat_map(edges: DataFrame) -> DataFrame:
    """Adjacency of every node by every node."""
    n = graph.nodes(edges)
    return relational.cross_tab(n.select(F.col("node").alias("src")), n.select(F.col("node").alias("dst")), edges.select("src", "dst"), "src", "dst")


def graph_nodes(defs: DataFrame) -> DataFrame:
    """One node a name, the last definition of it."""
    return defs.groupBy("name").agg(F.max_by(F.struct("category", "path"), F.struct("path", "ordinal")).alias("d")).select("name", "d.*")
