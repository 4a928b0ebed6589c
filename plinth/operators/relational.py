"""Top-k, sampling, windows, duplicates and anti joins over any table.

Operators take column names.  Order is always explicit: ties are settled by the
columns given as ``ordinal``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import scalar

MAJOR = ("refactor", "restructure", "major", "breaking", "release")


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top_k(df: DataFrame, by: str, k: int, *ordinal: str) -> DataFrame:
    return df.orderBy(F.desc(by), *[F.asc(o) for o in ordinal]).limit(k)


def hotspots(df: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Keys by number of rows; ties by key."""
    return top_k(count_by(df, key, name="churn"), "churn", k, key)


def churn(df: DataFrame, key: str, exclude: str = "->") -> DataFrame:
    """Rows of each key that doesn't contain ``exclude`` (renames)."""
    return count_by(df.where(~F.col(key).contains(exclude)), key, name="churn")


def orphans(left: DataFrame, right: DataFrame, on: Sequence[str] | str, right_on: Sequence[str] | str | None = None) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    keys = [on] if isinstance(on, str) else list(on)
    other = keys if right_on is None else [right_on] if isinstance(right_on, str) else list(right_on)
    r = right.select(*[F.col(o).alias(f"_r{i}") for i, o in enumerate(other)])
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & (left[k] == r[f"_r{i}"])
    return left.join(r, condition, "left_anti")


def exact_duplicates(df: DataFrame, text: str, ordinal: str) -> DataFrame:
    """``hash, n, members`` of texts that occur more than once; members by ordinal."""
    grouped = df.where(F.col(text).isNotNull()).groupBy(scalar.content_hash(text).alias("hash"))
    return grouped.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(ordinal)).alias("members")).where("n > 1")


def duplicate_statistics(blocks: DataFrame, hash_col: str, lines: str, variants: DataFrame | None = None) -> DataFrame:
    """One row of block and line counts: all, in exact duplicates, in variant groups.

    ``variants``: ``group_id`` and ``lines`` of each member of a variant group.
    Percentages are exact ratios of lines times 100; 0 without lines."""
    groups = blocks.groupBy(hash_col).agg(F.count("*").alias("n"), F.sum(lines).alias("l"))
    dup = F.col("n") > 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = groups.agg(
        zero(F.sum("n")).alias("total_blocks"),
        zero(F.sum("l")).alias("total_lines"),
        F.count_if(dup).alias("duplicate_groups"),
        zero(F.sum(F.when(dup, F.col("n")))).alias("duplicate_blocks"),
        zero(F.sum(F.when(dup, F.col("l")))).alias("duplicate_lines"),
    )
    if variants is None:
        extra = out.select(*[F.lit(0).cast("bigint").alias(c) for c in ("variant_groups", "variant_blocks", "variant_lines")])
    else:
        extra = variants.agg(F.count_distinct("group_id").alias("variant_groups"), F.count("*").alias("variant_blocks"), zero(F.sum("lines")).alias("variant_lines"))
    share = lambda c: F.when(F.col("total_lines") > 0, F.col(c) * 100.0 / F.col("total_lines")).otherwise(F.lit(0.0))
    both = out.crossJoin(extra)
    return both.withColumn("duplicate_percentage", share("duplicate_lines")).withColumn("variant_percentage", share("variant_lines"))


def name_variants(df: DataFrame, name: str, hash_col: str, path: str, ordinal: str) -> DataFrame:
    """Names with several implementations: one row an implementation.

    The first hash of a name is its base; a hash's path is the last that has it."""
    per_hash = df.groupBy(name, hash_col).agg(F.min(ordinal).alias("first_seen"), F.max_by(path, ordinal).alias(path))
    w = Window.partitionBy(name)
    ranked = per_hash.withColumn("n_implementations", F.count("*").over(w)).withColumn("position", F.row_number().over(w.orderBy("first_seen")))
    return ranked.where("n_implementations > 1").withColumn("base_hash", F.first_value(hash_col).over(w.orderBy("position"))).withColumn("is_base", F.col("position") == 1)


def next_older(df: DataFrame, key: str, newest_first: Sequence[Column | str], partition: Sequence[str] = ()) -> DataFrame:
    """Each row with the ``key`` of the next older one as ``before``; the oldest goes."""
    w = Window.partitionBy(*partition).orderBy(*newest_first)
    return df.withColumn("before", F.lead(key).over(w)).where("before is not null")


def events_by_keyword(df: DataFrame, message: str, keywords=scalar.REFACTORING) -> DataFrame:
    """One row an event type that a message's words tell of (several are possible)."""
    return df.withColumn("event_type", F.explode(scalar.keyword_events(message, keywords)))


def numbered(df: DataFrame, *order: Column | str, name: str = "position", start: int = 1) -> DataFrame:
    """Rows numbered by a total order, without one task for all of them: counts of
    range partitions give each its offset."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    from plinth.operators._session import checkpoint

    sorted_ = checkpoint(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted_.groupBy("_part").count()
    base = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + local + F.lit(start)).cast("bigint")).drop("_part", "_at", "_base")


def sample(df: DataFrame, most: int, strategy: str, ordinal: Sequence[Column | str], size: Column | None = None, message: str | None = None) -> DataFrame:
    """At most ``most`` rows: ``all`` the first ones, ``uniform`` every (count div
    most)-th, ``major`` those of the largest ``size``, doubled where the message
    tells of a large change.  Any other strategy is ``uniform``."""
    if most < 1:
        raise ValueError("most must be positive")
    if strategy == "all":
        return df.orderBy(*ordinal).limit(most)
    if strategy == "major":
        if size is None:
            raise ValueError("major sampling needs a size")
        told = F.lower(F.col(message)).rlike("|".join(MAJOR)) if message else F.lit(False)
        scored = df.withColumn("score", size * F.when(told, 2).otherwise(1))
        return scored.orderBy(F.desc("score"), *ordinal).limit(most)
    step = max(1, df.count() // most)
    n = numbered(df, *ordinal, name="_n", start=0)
    return n.where((F.col("_n") % step == 0) & (F.col("_n") < step * most)).drop("_n")


def trends(df: DataFrame, key: str, time: str, value: str, ordinal: str | None = None) -> DataFrame:
    """Trend of each key with at least two values: mean of the first half (n div
    2 values) against the rest; means are taken over exact decimals."""
    order = [time] + ([ordinal] if ordinal else [])
    w = Window.partitionBy(key)
    rn, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    v = F.col(value).cast("decimal(18,4)")
    cut = df.where(F.col(value).isNotNull()).select(key, F.struct(*order).alias("_o"), v.alias("_v"), (rn <= F.floor(n / 2)).alias("_first"))
    out = cut.groupBy(key).agg(
        F.count("*").alias("n_points"),
        F.max("_v").cast("double").alias("max_value"),
        F.min("_v").cast("double").alias("min_value"),
        F.max_by("_v", "_o").cast("double").alias("current_value"),
        (F.sum(F.when(F.col("_first"), F.col("_v"))).cast("double") / F.count_if("_first")).alias("_a"),
        (F.sum(F.when(~F.col("_first"), F.col("_v"))).cast("double") / F.count_if(~F.col("_first"))).alias("_b"),
    )
    return out.where("n_points >= 2").withColumn("direction", scalar.trend_direction("_a", "_b")).drop("_a", "_b")


def flow_counts(definitions: DataFrame, usages: DataFrame, name: str, usage_name: str | None = None) -> DataFrame:
    """Definitions and usages of each name, either side may be missing."""
    d = count_by(definitions, name, name="definition_count")
    u = count_by(usages.select(F.col(usage_name or name).alias(name)), name, name="usage_count")
    both = d.join(u, name, "full_outer").select(name, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("definition_count", "usage_count")])
    return both.withColumn("is_redefined", F.col("definition_count") > 1).withColumn("is_orphan", (F.col("usage_count") == 0) & (F.col("definition_count") > 0)).withColumn("is_undefined", F.col("definition_count") == 0)


def distinct_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def cross_tab(rows: DataFrame, columns: DataFrame, facts: DataFrame, row: str, column: str, name: str = "n") -> DataFrame:
    """Every row by every column with the number of facts, 0 included."""
    counts = count_by(facts, row, column, name=name)
    grid = rows.select(row).distinct().crossJoin(columns.select(column).distinct())
    return grid.join(counts, [row, column], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def truncated(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The first ``k`` items of each group, and how many there are beyond."""
    items = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("_all"))
    return items.select(group, F.slice("_all", 1, k).alias("shown"), F.greatest(F.size("_all") - k, F.lit(0)).alias("n_more"))
