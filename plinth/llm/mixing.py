"""Mixing sources to target weights by weighted fair queueing.

Inside each source the documents are shuffled by a hash of their id.  A
document's virtual finish time is the cumulative tokens of its source, itself
included, divided by the source's target weight; the mix is the documents by
virtual finish time, cut where the cumulative tokens of all sources exceed the
budget.

Prefix sums have two levels, so that no source, hot as it may be, has to pass
through one task: totals by the leading hex digits of the shuffle hash, their
running sums, then a window inside each bucket.  The cut is found alike, by
totals over buckets of the finish time.

Nulls, ties, odd input: a null source is a source of its own (weight
``default_weight``, as any source without one); a weight of 0 drops a source; a
null or empty text has 0 tokens and takes its place without using budget; a null
id is hashed as an empty one.  Documents of a source that share the hash and id
(repeated rows) finish together, so they are all in or all out; documents that
finish at the same time are ordered by id.  The mix is cut before the first
finish time at which the budget would be exceeded.  An empty table gives an
empty result.  Clashing column names get a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm._text import count_words, pieces
from plinth.llm._util import checkpoint, free_name, quoted


def with_words(docs: DataFrame, keep: dict[str, str], text_col: str) -> DataFrame:
    """The columns ``keep`` (name: SQL type), with ``_tokens``, the number of words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_text")):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(count_words(batch.column("_text")))], names=[*keep, "_tokens"])

    return docs.mapInArrow(run, "".join(f"{c} {t}, " for c, t in keep.items()) + "_tokens bigint")


def shuffle_key(name: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(name).cast("string"), F.lit(""))))


def _weight(source: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for s, w in sorted(weights.items()):
        out = F.when(source.eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(out)
    return out


def finish_times(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, default_weight: float = 1.0, digits: int = 3) -> DataFrame:
    """``_id, _source, _key, _tokens, _vft`` of every document of a positive weight."""
    keyed = docs.select(quoted(id_col).alias("_id"), quoted(source_col).cast("string").alias("_source"), shuffle_key(id_col, seed).alias("_key"), quoted(text_col).cast("string").alias("_text"))
    keyed = with_words(keyed, {"_id": docs.schema[id_col].dataType.simpleString(), "_source": "string", "_key": "string"}, text_col)
    keyed = keyed.withColumn("_w", _weight(F.col("_source"), weights, default_weight)).where("_w > 0").withColumn("_bucket", F.substring("_key", 1, digits))
    totals = keyed.groupBy("_source", "_bucket").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.withColumn("_cum", F.sum("_tokens").over(within))
    joined = local.join(base, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.select("_id", "_source", "_key", "_tokens", ((F.col("_base") + F.col("_cum")) / F.col("_w")).alias("_vft"))


def cutoff(times: DataFrame, budget: int, levels: int = 3, fan_out: int = 4096) -> float | None:
    """The first finish time at which the cumulative tokens exceed the budget; None if never.

    Each level splits the bucket in which the budget runs out into ``fan_out``;
    the last is decided exactly over its distinct finish times."""
    span = times.agg(F.min("_vft"), F.max("_vft"), F.sum("_tokens")).first()
    if span[0] is None or (span[2] or 0) <= budget:
        return None
    low, high, used = float(span[0]), float(span[1]), 0
    part = times
    for _ in range(levels):
        if high <= low:
            break
        width = (high - low) / fan_out
        place = F.least(F.floor((F.col("_vft") - F.lit(low)) / F.lit(width)), F.lit(fan_out - 1))
        inside = part.where((F.col("_vft") >= low) & (F.col("_vft") <= high))
        rows = inside.groupBy(place.alias("b")).agg(F.sum("_tokens").alias("n"), F.min("_vft").alias("lo"), F.max("_vft").alias("hi")).collect()  # fan_out rows at most
        for r in sorted(rows, key=lambda r: r["b"]):
            if used + r["n"] > budget:
                low, high = r["lo"], r["hi"]
                break
            used += r["n"]
        if len(rows) <= 1:
            break
    last = times.where((F.col("_vft") >= low) & (F.col("_vft") <= high)).groupBy("_vft").agg(F.sum("_tokens").alias("n"))
    run = F.sum("n").over(Window.orderBy("_vft"))  # one bucket of the last level
    found = last.select("_vft", (run + F.lit(used)).alias("run")).where(F.col("run") > budget).agg(F.min("_vft")).first()[0]
    return found


def _timed(docs: DataFrame, weights: dict[str, float], budget: int | None, share: float | None, id_col: str, source_col: str, text_col: str, seed: int, default_weight: float) -> DataFrame:
    """The finish times of the mix; the budget is given, or a share of the tokens
    of all sources of a positive weight, rounded down."""
    if (budget is None) == (share is None) or (budget or 0) < 0 or (share or 0) < 0:
        raise ValueError("either a budget or a share, not negative")
    times = checkpoint(finish_times(docs, weights, id_col, source_col, text_col, seed, default_weight))
    if budget is None:
        budget = int(share * (times.agg(F.sum("_tokens")).first()[0] or 0))
    end = cutoff(times, budget)
    return times if end is None else times.where(F.col("_vft") < end)


def mix(docs: DataFrame, weights: dict[str, float], budget: int | None = None, share: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, default_weight: float = 1.0) -> DataFrame:
    """The mix, range-sorted: ``id, source, n_tokens, virtual_finish``."""
    kept = _timed(docs, weights, budget, share, id_col, source_col, text_col, seed, default_weight)
    return kept.orderBy("_vft", "_id").select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_tokens").alias("n_tokens"), F.col("_vft").alias("virtual_finish"))


def mixed_documents(docs: DataFrame, weights: dict[str, float], budget: int | None = None, share: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, default_weight: float = 1.0, max_broadcast: int = 50_000) -> DataFrame:
    """The rows of the mix with all their columns.  A source's part of the mix is
    a prefix of its shuffled order, so one row a source (its last shuffle key)
    decides; up to ``max_broadcast`` sources that is broadcast and no text moves,
    beyond it the join is shuffled."""
    kept = _timed(docs, weights, budget, share, id_col, source_col, text_col, seed, default_weight)
    s, k = free_name(docs, "_last_source"), free_name(docs, "_last_key")
    ends = checkpoint(kept.groupBy(F.col("_source").alias(s)).agg(F.max(F.struct("_key", "_id")).alias(k)))
    ends = F.broadcast(ends) if ends.count() <= max_broadcast else ends
    mine = F.struct(shuffle_key(id_col, seed).alias("_key"), quoted(id_col).alias("_id"))
    return docs.join(ends, quoted(source_col).cast("string").eqNullSafe(F.col(s)) & (mine <= F.col(k)), "left_semi")
