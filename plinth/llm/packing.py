"""Best-fit decreasing packing of documents into bins of a fixed token capacity.

A document longer than the capacity is cut into full pieces, each a bin of its
own, and a rest; no token is dropped.  Pieces are placed by falling length, each
into the open bin with the least room that still fits.  The open bins' rooms are
kept in a segment tree over the capacities 1..capacity, so that the tightest bin
is found in logarithmic time, whatever the number of bins.

Packing runs in groups: about ``group_size`` documents each by a hash of id and
length, so that groups are packed in parallel and one group fits a task.  Of
documents that share both (repeated rows, null ids), equal as they are to packing,
only the number is shuffled; they are dealt to groups in runs of
``group_size``.

Nulls, ties, odd input: a null or empty text has no tokens, and gives no piece;
a null id is packed like any other; texts of any length are counted whole; equal
lengths are placed by id, and among bins of equal room the one opened first is
filled.  Rows that share an id are packed each, told apart by ``copy``, which
counts them by length.  An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm._util import quoted
from plinth.llm.mixing import with_words


class RoomTree:
    """Segment tree over rooms 0..capacity: which rooms have an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[deque] = [deque() for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest bin with at least ``need`` room, removed."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first right neighbour with a bin
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.bins[room].popleft()


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in bin) of each length, given in falling order."""
    tree, out, opened = RoomTree(capacity), [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, b = capacity, opened
            opened += 1
        else:
            room, b = found
        out.append((b, capacity - room))
        if room > n:
            tree.add(room - n, b)
    return out


def pack_group(ids: list, copies: list[int], tokens: np.ndarray, capacity: int) -> dict[str, list]:
    pieces = []
    for k, n in enumerate(tokens.tolist()):
        full, rest = divmod(n, capacity)
        pieces += [(capacity, k, i) for i in range(full)]
        if rest:
            pieces.append((rest, k, full))
    order = lambda p: (-p[0], ids[p[1]] is None, ids[p[1]] if ids[p[1]] is not None else 0, copies[p[1]], p[2])
    pieces.sort(key=order)
    placed = best_fit([p[0] for p in pieces], capacity)
    return {
        "bin": [b for b, _ in placed],
        "offset": [o for _, o in placed],
        "doc": [ids[p[1]] for p in pieces],
        "copy": [copies[p[1]] for p in pieces],
        "piece": [p[2] for p in pieces],
        "start": [p[2] * capacity for p in pieces],
        "n": [p[0] for p in pieces],
    }


def pack(docs: DataFrame, capacity: int = 2048, group_size: int = 8192, id_col: str = "doc_id", text_col: str = "text", n_docs: int | None = None) -> DataFrame:
    """Placement of each piece: ``group_id, bin_id, bin_offset, id, copy, piece,
    start_token, n_tokens``.  A bin is (group_id, bin_id)."""
    if capacity < 1 or group_size < 1:
        raise ValueError("capacity and group_size must be positive")
    total = docs.count() if n_docs is None else n_docs
    groups = max(1, -(-total // group_size))
    kind = docs.schema[id_col].dataType.simpleString()
    sized = with_words(docs.select(quoted(id_col).alias("_id"), quoted(text_col).cast("string").alias("_text")), {"_id": kind}, text_col).withColumnRenamed("_tokens", "_n")
    same = sized.groupBy("_id", "_n").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as an id has lengths
    dealt = same.withColumn("_c", before).withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / F.lit(group_size)))))
    dealt = dealt.select("_id", "_n", (F.col("_c") + F.col("_run") * group_size).alias("_c"), F.least(F.lit(group_size), F.col("_m") - F.col("_run") * group_size).alias("_m"), "_run")
    sized = dealt.withColumn("_g", F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_n"), F.col("_run")), F.lit(groups)).cast("int"))
    name = "`" + id_col.replace("`", "``") + "`"
    schema = f"group_id int, bin_id int, bin_offset int, {name} {kind}, copy bigint, piece int, start_token bigint, n_tokens int"

    def run(tables: Iterator[pa.Table] | pa.Table) -> pa.Table:
        t = tables.sort_by([("_id", "ascending"), ("_n", "ascending"), ("_c", "ascending")])
        times = t.column("_m").to_numpy()
        at = np.repeat(np.arange(len(times)), times)
        k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        ids, tokens = t.column("_id").take(pa.array(at)).to_pylist(), t.column("_n").to_numpy()[at]
        copies = (t.column("_c").to_numpy()[at] + k).tolist()
        out = pack_group(ids, copies, tokens, capacity)
        g = t.column("_g")[0].as_py()
        ints = lambda v, kind: pa.array(v, kind)
        arrays = [ints([g] * len(out["bin"]), pa.int32()), ints(out["bin"], pa.int32()), ints(out["offset"], pa.int32()), pa.array(out["doc"], t.schema.field("_id").type)]
        arrays += [ints(out["copy"], pa.int64()), ints(out["piece"], pa.int32()), ints(out["start"], pa.int64()), ints(out["n"], pa.int32())]
        return pa.Table.from_arrays(arrays, names=["group_id", "bin_id", "bin_offset", id_col, "copy", "piece", "start_token", "n_tokens"])

    return sized.groupBy("_g").applyInArrow(run, schema)
