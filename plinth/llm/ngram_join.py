"""N-gram Jaccard self-join of documents by chosen paths.

A document is the set of its word n-grams.  Its embedding is ``coordinates``
min-wise hashes; equality on a coordinate means a shared token, with the
probability of the pair's Jaccard similarity.  A run splits the documents on
``branches`` = ceil(1 / threshold) sampled coordinates.  A bucket of more than
``limit`` members is split again on coordinates sampled from its path, by the
next shuffle, down to ``max_depth`` splits; small buckets are compared pair by
pair.  What is still large then, or keeps most members when it is split (texts
that all resemble each other), is cut in blocks by a hash, and each pair of
blocks compared on its own, so that no bucket falls to one task.  Runs
are repeated: with survival probability q of a pair at the threshold through all
``max_depth`` splits, ``runs`` is the least number with
1 - (1 - q)**runs >= target recall.

Before anything is paired, equal texts become one class (by a 64-bit hash), with
the least id as its representative.  Bucket members carry one byte a coordinate;
pairs whose estimate isn't ``band`` standard deviations below the threshold are
measured on their whole n-gram sets.  For that, texts are placed by their least
partner, so that a group of near copies meets in one task; beyond ``group_size``
texts a group is cut in blocks, too.

``links``: ``doc_id, group_id, copy_of, n_links`` of every document that has a
link: the least id of all that links connect, the least id with the same text,
and the number of other (id, text) linked to it, copies included.  Every pair is
measured and counted; what leaves a task is a number and a tree edge a text.

``all_pairs``: ``doc_a < doc_b, jaccard, copy``.  Every link between different
texts, as a pair of representatives with the exact similarity (``copy`` false),
and every further id of a text with its representative (``copy`` true,
similarity 1); links between copies are implied.  Its rows grow with the square
of a group of near copies.

``keep_one`` needs connections only: in each bucket, pairs surely above the
threshold give a star a connected part, and other pairs are measured only
between such parts.

Documents with fewer words than ``n`` are one gram of all their words.  Nulls,
ties, odd input: null, empty and wordless texts and null ids take no part; texts
of any length are read whole; repeated rows are one; rows that share an id are
versions of one document, never paired with each other (a link between their
texts is given by another id that has the text, if there is one); an empty table
gives an empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm._text import as_array, inside, mix, pieces, row_of, window_hashes, word_codes
from plinth.llm._util import checkpoint, free_name, quoted, shuffle_partitions
from plinth.llm.blocks import release
from plinth.llm.components import components

CHUNK = 1 << 16
PATH = np.uint64(0xD6E8FEB86659FD93)


def grams_of(col, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams (with repeats), row by row, and their number in each row."""
    codes, offsets = word_codes(col)
    sizes = np.diff(offsets)
    hashes = window_hashes(codes, n)
    whole = inside(offsets, n, len(codes))[: len(hashes)]
    grams, row = hashes[whole], row_of(offsets)[: len(hashes)][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        extra = np.array([window_hashes(codes[offsets[r] : offsets[r + 1]], int(sizes[r]))[0] for r in short], np.uint64)
        at = np.searchsorted(row, short)
        grams, row = np.insert(grams, at, extra), np.insert(row, at, short)
    return grams, np.bincount(row, minlength=len(sizes))


def min_hashes(grams: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """Min-wise hashes of non-empty rows (``counts`` > 0)."""
    rng = np.random.default_rng(20240229)
    flips = rng.integers(0, 1 << 32, coordinates, np.uint64).astype(np.uint32)
    odd = rng.integers(0, 1 << 32, coordinates, np.uint64).astype(np.uint32) | np.uint32(1)
    x = (mix(grams) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.empty((len(counts), coordinates), np.uint32)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, side="right")))
        part, at = x[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo]
        for i in range(coordinates):
            out[lo:hi, i] = np.minimum.reduceat((part ^ flips[i]) * odd[i], at)
        lo = hi
    return out


def roots(run: int, rows: int) -> np.ndarray:
    """Path of each row before the first split of a run."""
    return np.full(rows, mix(np.array([run + 1], np.uint64) * PATH)[0], np.uint64)


def children(path: np.ndarray, mins: np.ndarray, branches: int) -> list[np.ndarray]:
    """Path keys of each row after one more split, an array for each branch."""
    rows, t, first = np.arange(len(mins)), np.uint64(mins.shape[1]), mix(path)
    out = []
    for j in range(branches):
        coordinate = (first + np.uint64(j) * (t // np.uint64(branches))) % t
        out.append(mix(path * PATH + (mins[rows, coordinate.astype(np.int64)].astype(np.uint64) << np.uint64(8)) + np.uint64(j + 1)))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of byte sketches, without the chance matches."""
    return unbiased((a == b).mean(axis=-1))


def unbiased(share):
    return (share - 1 / 256) / (1 - 1 / 256)


def near_in_bucket(sketches: np.ndarray, side: np.ndarray, low: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, estimate) of the pairs i < j of a bucket whose estimate is ``low`` or
    more, in blocks; where ``side`` isn't all zero, of pairs with different sides."""
    t = sketches.shape[1]
    columns = np.ascontiguousarray(sketches.T)
    step = max(1, 16 * CHUNK // len(sketches))
    cross = side.any()
    for lo in range(0, len(sketches) - 1, step):
        hi = min(len(sketches), lo + step)
        same = np.zeros((hi - lo, len(sketches) - lo), np.uint16)
        for c in columns:
            same += c[lo:hi, None] == c[None, lo:]
        s = unbiased(same / t)
        i, j = np.nonzero(np.triu(s >= low, 1))
        est = s[i, j]
        if cross:
            apart = side[lo + i] != side[lo + j]
            i, j, est = i[apart], j[apart], est[apart]
        yield lo + i, lo + j, est


def connections(n: int, i: np.ndarray, j: np.ndarray, s: np.ndarray, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) that keep the connected parts of a bucket: stars in place of
    the pairs from ``high`` on, and the other pairs between the parts these make."""
    sure = s >= high
    a, b, part = i[sure], j[sure], np.arange(n)
    while True:
        least = np.minimum(part[a], part[b])
        new = part.copy()
        np.minimum.at(new, part[a], least)
        np.minimum.at(new, part[b], least)
        new = new[new]
        if (new == part).all():
            break
        part = new
    member = np.flatnonzero(part != np.arange(n))
    open_ = np.flatnonzero(~sure & (part[i] != part[j]))
    return np.concatenate([part[member], i[open_]]), np.concatenate([member, j[open_]]), np.arange(len(member) + len(open_)) < len(member)


def survival(branches: int, threshold: float, depth: int) -> float:
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - threshold * q) ** branches
    return q


def runs_needed(branches: int, threshold: float, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(branches, threshold, depth))))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_node, _id, _text``; the node is a hash of the text."""
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).cast("string").alias("_text")).where("_id is not null and _text is not null")
    return rows.select(F.xxhash64("_text").alias("_node"), "_id", "_text")


def classes(rows: DataFrame, n: int, coordinates: int) -> DataFrame:
    """``_node, _mins, _rep`` of each distinct text with words: its min-wise hashes
    (two bytes each) and its least id."""
    kind = rows.schema["_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_text")):
            grams, counts = grams_of(batch.column("_text"), n)
            some = np.flatnonzero(counts)
            if len(some):
                mins = (min_hashes(grams, counts[some], coordinates) >> np.uint32(11)).astype("<u2")
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * coordinates), len(some), [None, pa.py_buffer(np.ascontiguousarray(mins))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_node").take(pa.array(some)), batch.column("_id").take(pa.array(some)), blob], names=["_node", "_id", "_mins"])

    each = rows.mapInArrow(describe, f"_node bigint, _id {kind}, _mins binary")
    return checkpoint(each.groupBy("_node").agg(F.first("_mins").alias("_mins"), F.min("_id").alias("_rep")))


def candidates(sketches: DataFrame, threshold: float, coordinates: int, limit: int, target_recall: float, band: float, max_depth: int, connect: bool) -> DataFrame:
    """``_a < _b, _sure``: pairs of nodes whose estimate isn't far below the threshold, or with
    ``connect`` what connects them (``_sure`` where nothing is left to be measured)."""
    spark = sketches.sparkSession
    branches = math.ceil(1 / threshold)
    runs = runs_needed(branches, threshold, max_depth, target_recall)
    sigma = math.sqrt(threshold * (1 - threshold) / coordinates)
    low, high = max(0.02, threshold - band * sigma), min(0.999, threshold + band * sigma)

    def fixed(column: pa.Array, kind: str) -> np.ndarray:
        width = coordinates * np.dtype(kind).itemsize
        raw = as_array(column).cast(pa.binary(width))
        return np.frombuffer(raw.buffers()[1], kind, len(raw) * coordinates, raw.offset * width).reshape(-1, coordinates)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mins = fixed(batch.column("_mins"), "<u2")
            low_bytes = np.ascontiguousarray(mins.astype(np.uint8))
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(coordinates), len(mins), [None, pa.py_buffer(low_bytes)]).cast(pa.binary())
            begin = [roots(run, len(mins)) for run in range(runs)] if "_key" not in batch.schema.names else [batch.column("_key").to_numpy().view(np.uint64)]
            for path in begin:
                for key in children(path, mins, branches):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("_node"), sketch], names=["_key", "_node", "_sketch"])

    def split_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in children(batch.column("_key").to_numpy().view(np.uint64), fixed(batch.column("_mins"), "<u2"), branches):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("_of")], names=["_key", "_of"])

    entry = "_key bigint, _node bigint, _sketch binary"
    entries, settled = sketches.select("_node", "_mins").mapInArrow(split, entry), []
    sized = entries.select("_key", F.lit(0).cast("bigint").alias("_of"))

    def cut_in_blocks(entries: DataFrame, hot: DataFrame) -> DataFrame:
        cut = entries.join(hot, "_key").withColumn("_cut", F.ceil(F.col("count") / limit).cast("int"))
        cut = cut.withColumn("_own", F.pmod(F.xxhash64("_node"), "_cut").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)))
        return cut.select(F.xxhash64("_key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_key"), "_node", "_sketch", (F.col("_own") > F.col("_other")).cast("int").alias("_side"))

    for depth in range(1, max_depth + 1):
        counts = sized.groupBy("_key").agg(F.count("*").alias("count"), F.max("_of").alias("_of")).where(F.col("count") > limit)
        whole = F.lit(True) if depth == max_depth else F.col("count") > 0.7 * F.col("_of")  # another split wouldn't part its members
        hot = checkpoint(counts.select("_key", "count", (whole & (F.col("_of") > 0) | F.lit(depth == max_depth)).alias("_whole")))
        n_hot = hot.count()
        few = lambda t: F.broadcast(t) if n_hot <= 500_000 else t  # noqa: B023, E731
        settled.append((entries.join(few(hot.select("_key")), "_key", "left_anti") if n_hot else entries).withColumn("_side", F.lit(0)))
        if not n_hot:
            break
        settled.append(cut_in_blocks(entries, few(hot.where("_whole").select("_key", "count"))))
        parents = few(hot.where("not _whole").select("_key", F.col("count").alias("_of")))
        large = checkpoint(entries.select("_key", "_node").join(parents, "_key"))
        if large.isEmpty():
            break
        inner = large.join(sketches.select("_node", "_mins"), "_node").select("_key", "_node", "_mins", "_of")
        entries = inner.mapInArrow(split, entry)
        sized = inner.mapInArrow(split_sizes, "_key bigint, _of bigint")
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, side = table.column("_key").to_numpy(), table.column("_side").to_numpy()
            sketch, nodes = fixed(table.column("_sketch"), "u1"), table.column("_node").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            sizes = np.diff(edges)
            few = (sizes > 1) & (sizes <= 16)
            at = np.flatnonzero(np.repeat(few, sizes))
            a, b, sure = [], [], []
            for lag in range(1, 16):  # small buckets all at once
                pair = np.flatnonzero(keys[at[lag:]] == keys[at[:-lag]]) if len(at) > lag else at[:0]
                if not len(pair):
                    break
                for lo in range(0, len(pair), CHUNK):
                    i, j = at[pair[lo : lo + CHUNK]], at[pair[lo : lo + CHUNK] + lag]
                    s = similarity(sketch[i], sketch[j])
                    a.append(i[s >= low]), b.append(j[s >= low]), sure.append(connect & (s[s >= low] >= high))
            for k in np.flatnonzero(sizes > 16):
                lo, hi = edges[k], edges[k + 1]
                found = near_in_bucket(sketch[lo:hi], side[lo:hi], low)
                if connect:
                    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
                    i, j, known = connections(hi - lo, i, j, s, high)
                    a.append(i + lo), b.append(j + lo), sure.append(known)
                else:
                    for i, j, _ in found:
                        yield pairs(nodes[i + lo], nodes[j + lo], np.zeros(len(i), bool))
            if a:
                yield pairs(nodes[np.concatenate(a)], nodes[np.concatenate(b)], np.concatenate(sure))

        def pairs(a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], names=["_a", "_b", "_sure"])

        for batch in batches:  # sorted by key; the last bucket of a batch may go on in the next
            keys = batch.column("_key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            if len(keys):
                held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    sorted_ = every.repartition(shuffle_partitions(spark), "_key").sortWithinPartitions("_key")
    found = sorted_.mapInArrow(compare, "_a bigint, _b bigint, _sure boolean")
    return found.groupBy("_a", "_b").agg(F.bool_or("_sure").alias("_sure"))


def place_sets(pairs: DataFrame, rows: DataFrame, reps: DataFrame, n: int, max_broadcast: int, group_size: int = 2000) -> tuple[DataFrame, DataFrame]:
    """``_p, _a, _b``: pairs by place, and ``_q, _node, _set``: the n-gram sets that each place needs."""
    both = pairs.select(F.col("_a").alias("_node"), F.col("_b").alias("_m")).union(pairs.select("_b", "_a"))
    label = checkpoint(both.groupBy("_node").agg(F.min("_m").alias("_m")).select("_node", F.least("_node", "_m").alias("_label")))
    cut = label.groupBy("_label").agg(F.ceil(F.count("*") / group_size).alias("_cut"))
    block = checkpoint(label.join(cut, "_label").select("_node", F.xxhash64("_label", F.pmod(F.xxhash64("_node"), "_cut")).alias("_block")))
    few = block.select("_node").join(reps.select("_node", "_rep"), "_node")
    few = F.broadcast(few) if block.count() <= max_broadcast else few

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_text")):
            grams, counts = grams_of(batch.column("_text"), n)
            ends = np.cumsum(counts)
            blobs = [np.unique(grams[e - c : e]).tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_node"), pa.array(blobs, pa.binary())], names=["_node", "_set"])

    chosen = rows.join(few, (rows["_node"] == few["_node"]) & (rows["_id"] == few["_rep"]), "left_semi").select("_node", "_text")
    each = chosen.mapInArrow(sets, "_node bigint, _set binary")
    parts = 4 * shuffle_partitions(pairs.sparkSession)
    of = lambda side: block.select(F.col("_node").alias(f"_{side}"), F.col("_block").alias(f"_block_{side}"))
    place = F.pmod(F.xxhash64(F.least("_block_a", "_block_b"), F.greatest("_block_a", "_block_b")), F.lit(parts)).cast("int")
    placed = checkpoint(pairs.join(of("a"), "_a").join(of("b"), "_b").select(place.alias("_p"), "_a", "_b"))
    wanted = placed.select(F.col("_p").alias("_q"), F.explode(F.array("_a", "_b")).alias("_node")).distinct()
    sent = wanted.join(each.dropDuplicates(["_node"]), "_node").select("_q", "_node", "_set")

    return placed, sent


def jaccards(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, x, y, similarity) of the pairs ``_a, _b``; x and y number the sorted nodes."""
    left = left.sort_by([("_a", "ascending"), ("_b", "ascending")])
    a, b = left.column("_a").to_numpy(), left.column("_b").to_numpy()
    nodes = right.column("_node").to_numpy()
    order = np.argsort(nodes)
    blobs = right.column("_set").to_pylist()
    held = [np.frombuffer(blobs[k], np.uint64) for k in order.tolist()]
    nodes, size = nodes[order], np.array([len(x) for x in held], np.int64)
    x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    common = np.zeros(len(a), np.int64)
    heads = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)
    for lo, hi in zip(heads[:-1], heads[1:], strict=True):
        mine = held[x[lo]]
        for at in range(lo, hi, 512):
            others = y[at : min(hi, at + 512)]
            flat = np.concatenate([held[k] for k in others])
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            common[at : at + len(others)] = np.add.reduceat(hit, np.cumsum(size[others]) - size[others], dtype=np.int64)
    return nodes, x, y, common / np.maximum(1, size[x] + size[y] - common)


def verify(pairs: DataFrame, rows: DataFrame, reps: DataFrame, n: int, max_broadcast: int) -> DataFrame:
    """``_a, _b, _s`` with the exact Jaccard similarity of the n-gram sets of two nodes."""

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, x, y, s = jaccards(left, right)
        return pa.table({"_a": nodes[x], "_b": nodes[y], "_s": pa.array(s, pa.float64())})

    placed, sent = place_sets(pairs, rows, reps, n, max_broadcast)
    return placed.groupBy("_p").cogroup(sent.groupBy("_q")).applyInArrow(measure, "_a bigint, _b bigint, _s double")


def links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    threshold: float = 0.5,
    coordinates: int = 128,
    limit: int = 2048,
    target_recall: float = 0.97,
    band: float = 4.0,
    max_depth: int = 4,
    max_broadcast: int = 200_000,
) -> DataFrame:
    """``id, group_id, copy_of, n_links`` of every document that has a link."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("0 < threshold <= 1 and n >= 1")
    spark, rows = docs.sparkSession, texts_of(docs, id_col, text_col)
    sketches = classes(rows, n, coordinates)
    ids = checkpoint(rows.select("_node", "_id").distinct())
    release(spark)
    pairs = checkpoint(candidates(sketches, threshold, coordinates, limit, target_recall, band, max_depth, connect=False))
    release(spark)
    placed, sent = place_sets(pairs, rows, sketches.select("_node", "_rep"), n, max_broadcast)
    size = ids.groupBy("_node").agg(F.count("*").alias("_n"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, x, y, s = jaccards(left, right)
        x, y = x[s >= threshold], y[s >= threshold]
        number = right.column("_n").to_numpy()[np.argsort(right.column("_node").to_numpy())]
        linked = (np.bincount(x, number[y], len(nodes)) + np.bincount(y, number[x], len(nodes))).astype(np.int64)
        up, down, _ = connections(len(nodes), x, y, np.ones(len(x)), 1.0)
        root = np.arange(len(nodes))
        root[down] = up
        some = np.flatnonzero(linked)
        return pa.table({"_node": nodes[some], "_root": nodes[root[some]], "_links": linked[some]})

    counted = placed.groupBy("_p").cogroup(sent.join(size, "_node").select("_q", "_node", "_set", "_n").groupBy("_q"))
    counted = checkpoint(counted.applyInArrow(count, "_node bigint, _root bigint, _links bigint"))
    release(spark)
    own = sketches.select("_node", "_rep").join(size, "_node").join(counted.groupBy("_node").agg(F.sum("_links").alias("_l")), "_node", "left")
    own = checkpoint(own.select("_node", "_rep", (F.coalesce("_l", F.lit(0)) + F.col("_n") - 1).alias("_links")).where("_links > 0"))
    reps = own.select("_node", "_rep")
    a, b = (reps.select(F.col("_node").alias(x), F.col("_rep").alias(y)) for x, y in (("_node", "_x"), ("_root", "_y")))
    members = checkpoint(ids.join(own, "_node").select("_id", "_rep", "_links"))
    edges = counted.join(a, "_node").join(b, "_root").select("_x", "_y").unionByName(members.select(F.col("_id").alias("_x"), F.col("_rep").alias("_y")))
    group = components(edges, "_x", "_y").select(F.col("node").alias("_id"), F.col("root").alias("_group"))
    each = members.groupBy("_id").agg(F.min("_rep").alias("copy_of"), F.sum("_links").alias("n_links")).join(group, "_id", "left")
    return each.select(F.col("_id").alias(id_col), F.coalesce("_group", "_id").alias("group_id"), "copy_of", "n_links")


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, coordinates: int, limit: int, target_recall: float, band: float, max_depth: int, max_broadcast: int, connect: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near pairs of nodes ``_a, _b, _s``, nodes with their least id, and ``_node, _id`` of all other ids."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("0 < threshold <= 1 and n >= 1")
    rows = texts_of(docs, id_col, text_col)
    sketches = classes(rows, n, coordinates)
    reps = sketches.select("_node", "_rep")
    release(docs.sparkSession)
    pairs = checkpoint(candidates(sketches, threshold, coordinates, limit, target_recall, band, max_depth, connect))
    release(docs.sparkSession)
    near = verify(pairs.where("not _sure"), rows, reps, n, max_broadcast).where(F.col("_s") >= threshold)
    if connect:
        near = near.unionByName(pairs.where("_sure").select("_a", "_b", F.lit(1.0).alias("_s")))
    others = rows.select("_node", "_id").join(reps, "_node").where("_id <> _rep").select("_node", "_rep", "_id").distinct()
    return near, reps, others


def all_pairs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    threshold: float = 0.5,
    coordinates: int = 128,
    limit: int = 2048,
    target_recall: float = 0.97,
    band: float = 4.0,
    max_depth: int = 4,
    max_broadcast: int = 200_000,
) -> DataFrame:
    """``doc_a < doc_b, jaccard, copy``: all links between different texts by their
    representatives, and each further id of a text with its representative."""
    near, reps, others = _linked(docs, id_col, text_col, n, threshold, coordinates, limit, target_recall, band, max_depth, max_broadcast, connect=False)
    left, right = (reps.select(F.col("_node").alias(node), F.col("_rep").alias(name)) for node, name in (("_a", "_x"), ("_b", "_y")))
    met = near.join(left, "_a").join(right, "_b")
    apart = met.where("_x <> _y").select("_x", "_y", "_s")
    one_id = met.where("_x = _y")  # two texts with one least id: the link is given by another id of either
    second = others.groupBy("_node").agg(F.min("_id").alias("_other"))
    for node in ("_a", "_b"):
        apart = apart.unionByName(one_id.join(second.withColumnRenamed("_node", node), node).select("_x", F.col("_other").alias("_y"), "_s"))
    linked = apart.select("_x", "_y", "_s", F.lit(False).alias("_copy")).unionByName(others.select(F.col("_rep").alias("_x"), F.col("_id").alias("_y"), F.lit(1.0).alias("_s"), F.lit(True).alias("_copy")))
    ends = (F.least("_x", "_y").alias("doc_a"), F.greatest("_x", "_y").alias("doc_b"))
    return linked.groupBy(*ends).agg(F.max("_s").alias("jaccard"), F.bool_or("_copy").alias("copy"))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    threshold: float = 0.5,
    coordinates: int = 128,
    limit: int = 2048,
    target_recall: float = 0.97,
    band: float = 4.0,
    max_depth: int = 4,
    max_broadcast: int = 500_000,
) -> DataFrame:
    """The rows, with all their columns, but of each group of similar documents
    (connected by pairs) only the one with the least id."""
    near, reps, others = _linked(docs, id_col, text_col, n, threshold, coordinates, limit, target_recall, band, max_depth, max_broadcast, connect=True)
    left, right = (reps.select(F.col("_node").alias(node), F.col("_rep").alias(name)) for node, name in (("_a", "_x"), ("_b", "_y")))
    edges = near.join(left, "_a").join(right, "_b").select("_x", "_y").unionByName(others.select(F.col("_rep").alias("_x"), F.col("_id").alias("_y")))
    name = free_name(docs, "_gone")
    gone = components(edges, "_x", "_y").select(F.col("node").alias(name))
    gone = F.broadcast(gone) if gone.count() <= max_broadcast else gone
    return docs.join(gone, quoted(id_col) == F.col(name), "left_anti")
