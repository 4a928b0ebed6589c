"""Connected components of an edge table, by alternating large and small stars.

Each round links every node's larger neighbours to its least neighbour (large
star), then its smaller neighbours (small star), until the edges are stars
around the least id of each component.  Rounds are few (logarithmic); each is
materialised in the shared checkpoint folder.  Null ends and loops are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm._util import checkpoint


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """``node, root`` of every node but the roots; ``root`` is the least id of its component."""
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    edges = checkpoint(edges)
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(low, F.col("u") == F.col("w"))
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = checkpoint(small)
        new = _mark(edges)
        if new == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
    raise RuntimeError("the components didn't settle")
