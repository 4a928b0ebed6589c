"""Repeated passages through a distributed suffix array (difference cover mod 3).

A passage is a run of at least ``min_words`` normalised words that occurs more
than once, in one text or several.  A text is known by its key, a hash of id and
text, so that rows which share an id but not the text are texts of their own.

1. *Tiles.*  A window of ``min_words`` words is assigned to the least hash among
   its runs of half that length (its anchor); consecutive windows with one
   anchor make a tile.  Equal windows have equal anchors, so only tiles whose
   anchor hash recurs can hold repeats.  Of tiles that are equal as a whole, the
   first (least id, key, position) stands for all; the windows of the others are
   repeats, and not the first.
2. *Suffix array* of the standing tiles' text, over 32-bit word codes.  The
   suffixes at positions of residue 1 and 2 modulo 3 are sampled.  Their triples
   of letters (16 to 18 words in all) are range-partitioned, sorted and named;
   names recur as triples of names until a name covers ``min_words - 2`` words
   exactly, or all names differ.
3. *Merge.*  Suffixes of residue 0 are ranked by (word, name of the next
   suffix) and merged with the sampled ones, residue 1 by the same key, residue
   2 by (word, word, name of the suffix after); the words behind the name are
   the last part of each key, so that the order is that of ``min_words`` words.
4. *Adjacent prefixes.*  Neighbours in the merged order are compared on their
   first ``min_words`` words: names stand for equal words, and every two residues
   have a key of words and one name in common that covers just that many.  Each
   run of equal ones is one repeated window, first where its (id, key, position)
   is least.

Every shuffle moves packed blocks, each round is materialised in the shared
checkpoint folder.  What the driver sees is a sample of sort keys (balance
only, never the result) and one count a round.

Result of ``repeats``: ``id, text_key, start_word, n_words, first``; the words
covered by repeated windows, those that are first occurrences and those that
aren't, as maximal intervals.  Nulls, ties, odd input: ids must be integers
(TypeError); null ids take part and come last in the order of ids; null and empty
texts and those shorter than ``min_words`` have no passages; very long texts are
read whole, in one batch each; rows that repeat an id and text are one text.  An
empty table gives an empty result; other columns are never read, whatever their
names (``text_key`` gets a leading underscore if the id column is called so).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm._text import BASE, INVERSE, _powers, inside, mix, pieces, window_hashes, word_codes
from plinth.llm._util import checkpoint, free_name, map_rows, quoted, shuffle_partitions
from plinth.llm.blocks import SCHEMA, cogrouped, gather, grouped, next_prime, release, scatter, scatter_table

TILE = np.dtype([("h", "<u8"), ("whole", "<u8"), ("id", "<i8"), ("key", "<i8"), ("at", "<i4"), ("span", "u1")])
RANGE = np.dtype([("id", "<i8"), ("key", "<i8"), ("at", "<i4"), ("span", "u1"), ("kind", "u1")])
SETTLED, SURE, OPEN = 0, 1, 2  # a repeat already; a tile that recurs as a whole; one that doesn't
NAME = np.dtype([("at", "<i4"), ("name", "<u8")])
TRIPLE = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("part", "<i4"), ("at", "<i4")])
SUFFIX = np.dtype([("words", "<u8"), ("last", "<u8"), ("x", "<u8"), ("y", "<u8"), ("id", "<i8"), ("key", "<i8"), ("at", "<i4"), ("residue", "u1"), ("sure", "u1")])
FOUND = np.dtype([("id", "<i8"), ("key", "<i8"), ("at", "<i4"), ("first", "u1")])
REGIONS = "_p int, id bigint, key bigint, start int, words binary, state binary"
LETTER = 6
NO_ID = (1 << 63) - 1  # stands for a null id in the order; the lowest bit of a key tells the two apart
LOW = np.uint64(0xFFFFFFFF)


def tiles(codes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, hash of the whole, row, first window, further windows) of each tile."""
    n, k = len(codes), (length + 1) // 2
    starts, w = n - length + 1, length - k + 1
    empty = np.empty(0, np.uint64)
    if starts <= 0:
        return empty, empty, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams, valid = window_hashes(codes, k), inside(offsets, length, n)[:starts]
    least = grams[:starts].copy()
    for o in range(1, w):
        np.minimum(least, grams[o : o + starts], out=least)
    anchor = np.zeros(starts, np.int64)
    for o in range(w - 1, -1, -1):
        anchor[grams[o : o + starts] == least] = o
    at = np.flatnonzero(valid)
    anchor = at + anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)
    new[1:] |= np.searchsorted(offsets, at[1:], "right") != np.searchsorted(offsets, at[:-1], "right")
    head = np.flatnonzero(new)
    first = at[head]
    last = at[np.append(head[1:], len(at)) - 1] if len(at) else first
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes) * _powers(BASE, n), dtype=np.uint64)])
    whole = mix((sums[last + length] - sums[first]) * _powers(INVERSE, n)[first] + mix((last - first).astype(np.uint64) + np.uint64(1)))
    row = np.searchsorted(offsets, first, "right") - 1
    return grams[anchor[head]], whole, row, first - offsets[row], last - first


def distinct(r: np.ndarray, fields: list[str]) -> np.ndarray:
    """Records sorted by ``fields``, of those that agree on all of them one."""
    r = r[np.lexsort([r[f] for f in reversed(fields)])]
    new = np.ones(len(r), bool)
    if len(r):
        new[1:] = np.any([r[f][1:] != r[f][:-1] for f in fields], axis=0)
    return r[new]


def choose(t: np.ndarray) -> np.ndarray:
    """RANGE records of the tiles of one partition whose anchor recurs."""
    t = distinct(t, ["h", "whole", "id", "key", "at"])
    if not len(t):
        return np.empty(0, RANGE)
    new_h = np.concatenate([[True], t["h"][1:] != t["h"][:-1]])
    group = np.cumsum(new_h) - 1
    t = t[np.bincount(group)[group] > 1]
    if not len(t):
        return np.empty(0, RANGE)
    new = np.concatenate([[True], (t["h"][1:] != t["h"][:-1]) | (t["whole"][1:] != t["whole"][:-1])])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)[group]
    out = np.empty(len(t), RANGE)
    out["id"], out["key"], out["at"], out["span"] = t["id"], t["key"], t["at"], t["span"]
    out["kind"] = np.where(~new, SETTLED, np.where(sizes > 1, SURE, OPEN))
    return out


def regions(ids: np.ndarray, keys: np.ndarray, texts: pa.Array, ranges: np.ndarray, length: int) -> dict[str, list]:
    """Maximal runs of words under standing tiles, with the state of each
    position: 0, or 1 + (tile recurs as a whole) where a window starts.  ``keys`` are distinct."""
    out: dict[str, list] = {"id": [], "key": [], "start": [], "words": [], "state": []}
    ranges = ranges[ranges["kind"] != SETTLED]
    ranges = ranges[np.lexsort([ranges["at"], ranges["key"]])]
    chosen = np.flatnonzero(np.isin(keys, ranges["key"]))
    if not len(chosen):
        return out
    codes, offsets = word_codes(texts.take(pa.array(chosen)))
    letters = np.maximum(codes >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    lo, hi = np.searchsorted(ranges["key"], keys[chosen]), np.searchsorted(ranges["key"], keys[chosen], "right")
    for k, base in enumerate(offsets[:-1]):
        mine = ranges[lo[k] : hi[k]]
        n = int(offsets[k + 1] - base)
        state = np.zeros(n + 1, np.uint8)
        cover = np.zeros(n + 2, np.int32)
        for a, s, kind in zip(mine["at"].tolist(), mine["span"].tolist(), mine["kind"].tolist(), strict=True):
            state[a : a + s + 1] = np.maximum(state[a : a + s + 1], 3 - kind)
            cover[a] += 1
            cover[a + s + length] -= 1
        on = np.concatenate([[0], (np.cumsum(cover[:n]) > 0).astype(np.int8), [0]])
        for s, e in zip(np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1), strict=True):
            out["id"].append(int(ids[chosen[k]])), out["key"].append(int(keys[chosen[k]])), out["start"].append(int(s))
            out["words"].append(letters[base + s : base + e].tobytes())
            out["state"].append(state[s:e].tobytes())
    return out


class Text:
    """The regions of a partition, one after another, each with room behind it."""

    def __init__(self, table: pa.Table, room: int):
        table = table.sort_by([("key", "ascending"), ("start", "ascending")])
        words = [np.frombuffer(x, np.uint32) for x in table.column("words").to_pylist()]
        sizes = np.array([len(x) for x in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + room)])
        self.words = np.zeros(begin[-1] + room, np.uint32)
        self.state = np.zeros(len(self.words), np.uint8)
        self.pos = np.full(len(self.words), -1, np.int32)
        self.region = np.zeros(len(self.words), np.int32)
        self.ids, self.keys = table.column("id").to_numpy(), table.column("key").to_numpy()
        for k, (x, s, b, p) in enumerate(zip(words, table.column("state").to_pylist(), begin, table.column("start").to_pylist(), strict=False)):
            self.words[b : b + len(x)] = x
            self.state[b : b + len(x)] = np.frombuffer(s, np.uint8)
            self.pos[b : b + len(x)] = np.arange(p, p + len(x))
            self.region[b : b + len(x)] = k
        self.sampled = np.flatnonzero((self.pos >= 0) & (self.pos % 3 > 0))

    def packed(self, at: np.ndarray, first: int, n: int = 2) -> np.ndarray:
        """``n`` <= 2 words from ``at + first`` in one number, order kept."""
        out = self.words[at + first].astype(np.uint64) << np.uint64(32)
        return out | self.words[at + first + 1] if n == 2 else out

    def part(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Range partition of the suffixes by their first words, two a column of ``bounds``."""
        out = np.zeros(len(at), np.int64)
        todo = [(np.arange(len(at)), 0, len(bounds), 0)]
        while todo:
            mine, lo, hi, depth = todo.pop()
            a = self.packed(at[mine], 2 * depth)
            low, high = (lo + np.searchsorted(bounds[lo:hi, depth], a, side) for side in ("left", "right"))
            deeper = (low < high) & (depth + 1 < bounds.shape[1])
            out[mine] = np.where(deeper, low, high)
            tied = np.flatnonzero(deeper)
            if len(tied):
                order = tied[np.argsort(low[tied], kind="stable")]
                for group in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
                    todo.append((mine[group], int(low[group[0]]), int(high[group[0]]), depth + 1))
        return out


def dense_names(records: np.ndarray, keys: list[str], part: int) -> tuple[np.ndarray, bool]:
    """Records sorted by ``keys``, and their order-preserving names."""
    order = np.lexsort([records[k] for k in reversed(keys)])
    records = records[order]
    new = np.zeros(len(records), bool)
    for k in keys:
        new[1:] |= records[k][1:] != records[k][:-1]
    names = (np.uint64(part) << np.uint64(36)) + np.cumsum(new).astype(np.uint64) + np.uint64(1)
    out = np.empty(len(records), NAME)
    out["at"], out["name"] = records["at"], names
    return scatter_table(records["part"], out), bool(new[1:].all())


def merged_order(s: np.ndarray) -> np.ndarray:
    """Indices of SUFFIX records in suffix order.

    x and y: residue 0, names of the next two suffixes; residue 1, of itself and
    the next; residue 2, of itself and the suffix after the next.  ``last``: the
    last two of the ``min_words`` words, which names alone may not reach."""
    w0, w01, end = s["words"] >> np.uint64(32), s["words"], s["last"] & LOW
    sampled, rest = np.flatnonzero(s["residue"] > 0), np.flatnonzero(s["residue"] == 0)
    sampled = sampled[np.lexsort([s["last"][sampled], s["x"][sampled]])]
    rest = rest[np.lexsort([end[rest], s["x"][rest], w0[rest]])]
    if not len(rest) or not len(sampled):
        return np.concatenate([sampled, rest])
    before = np.zeros(len(rest), np.int64)
    for residue, key, mine, tail in ((1, w0, s["x"], end), (2, w01, s["y"], np.zeros(len(s), np.uint64))):
        other = sampled[s["residue"][sampled] == residue]
        both = np.concatenate([other, rest])
        name = np.concatenate([s["y"][other], mine[rest]])
        order = np.lexsort([np.arange(len(both)), tail[both], name, key[both]])
        seen = np.cumsum(order < len(other))
        rank = np.empty(len(both), np.int64)
        rank[order] = seen
        before += rank[len(other) :]
    out = np.empty(len(s), np.int64)
    slots = np.arange(len(rest)) + before
    out[slots] = rest
    free = np.ones(len(s), bool)
    free[slots] = False
    out[free] = sampled
    return out


def equal_neighbours(s: np.ndarray) -> np.ndarray:
    """Whether each of the sorted SUFFIX records but the first has the ``min_words`` words of the one before."""
    a, b = s[:-1], s[1:]
    n1 = np.where(s["residue"] == 0, s["x"], s["y"])  # name of the next suffix; not for residue 2
    one = ((a["words"] ^ b["words"]) >> np.uint64(32) == 0) & (n1[:-1] == n1[1:]) & ((a["last"] ^ b["last"]) & LOW == 0)
    two = (a["words"] == b["words"]) & (a["y"] == b["y"])
    own = (a["x"] == b["x"]) & (a["last"] == b["last"])
    has = lambda r: (a["residue"] != r) & (b["residue"] != r)
    return np.where(has(2), one, np.where(has(1), two, own))


def adjacent(s: np.ndarray) -> np.ndarray:
    """FOUND records: windows that recur, by comparing neighbours."""
    if not len(s):
        return np.empty(0, FOUND)
    s = s[merged_order(s)]
    group = np.concatenate([[0], np.cumsum(~equal_neighbours(s))])
    sizes = np.bincount(group)
    order = np.lexsort([s["at"], s["key"], s["id"], group])
    first = np.zeros(len(s), np.uint8)
    first[order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]] = 1
    keep = (sizes[group] > 1) | (s["sure"] == 1)
    out = np.empty(int(keep.sum()), FOUND)
    for f in ("id", "key", "at"):
        out[f] = s[f][keep]
    out["first"] = first[keep]
    return out


def intervals(found: np.ndarray, length: int) -> np.ndarray:
    """(id, key, start, words, first) of the maximal intervals under windows."""
    found = distinct(found, ["first", "key", "at"])
    out = np.dtype([("id", "<i8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4"), ("first", "u1")])
    if not len(found):
        return np.empty(0, out)
    new = np.ones(len(found), bool)
    new[1:] = (found["key"][1:] != found["key"][:-1]) | (found["first"][1:] != found["first"][:-1]) | (found["at"][1:] > found["at"][:-1] + length)
    head = np.flatnonzero(new)
    last = found["at"][np.append(head[1:], len(found)) - 1]
    r = np.empty(len(head), out)
    for f, g in (("id", "id"), ("key", "key"), ("start", "at"), ("first", "first")):
        r[f] = found[g][head]
    r["n"] = last + length - r["start"]
    return r


def first_reach(cover: int) -> int:
    """Words of the first triples: as many as leave a multiple of three to ``cover``."""
    most = 3 * LETTER
    return cover if cover <= most else most - (most - cover) % 3


def next_shifts(reach: int, cover: int) -> tuple[int, int]:
    """Where the second and the third name of a triple begin; both multiples of
    three, so that they are sampled suffixes too.  The triple covers ``reach`` and the latter."""
    one = min(reach // 3 * 3, cover - reach)
    return one, min(2 * one, cover - reach)


def text_key(id_col: str, text_col: str):
    """Hash of id and text; its lowest bit says whether the id is null."""
    return F.xxhash64(quoted(id_col).cast("bigint"), quoted(text_col).cast("string")).bitwiseAND(F.lit(-2)).bitwiseOR(quoted(id_col).isNull().cast("bigint"))


def repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, start_word, n_words, first`` of all repeated passages."""
    if min_words < 4 or min_words > 500:
        raise ValueError("4 <= min_words <= 500")
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids must be integers")
    spark, length, cover = docs.sparkSession, min_words, min_words - 2
    parts = next_prime(shuffle_partitions(spark))
    reach, room = first_reach(cover), length + 3
    texts = docs.select(F.coalesce(quoted(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text_key(id_col, text_col).alias("key"), quoted(text_col).cast("string").alias("_text")).where("_text is not null")

    def find_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_text")):
            codes, offsets = word_codes(batch.column("_text"))
            h, whole, row, at, span = tiles(codes, offsets, length)
            t = np.empty(len(h), TILE)
            t["id"], t["key"] = batch.column("id").to_numpy()[row], batch.column("key").to_numpy()[row]
            t["h"], t["whole"], t["at"], t["span"] = h, whole, at, span
            yield scatter((h % np.uint64(parts)).astype(np.int64), t)

    def choose_tiles(table: pa.Table) -> pa.Table:
        r = choose(gather(table, TILE))
        return scatter_table(r["key"] % parts, r)

    ranges = checkpoint(grouped(texts.mapInArrow(find_tiles, SCHEMA), choose_tiles))
    release(spark)

    def cut_regions(left: pa.Table, right: pa.Table) -> pa.Table:
        r = gather(right, RANGE)
        keys, keep = np.unique(left.column("key").to_numpy(), return_index=True)
        out = regions(left.column("id").to_numpy()[keep], keys, left.column("_text").combine_chunks().take(pa.array(keep)), r, length)
        p = [x % parts for x in out["key"]]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip([p, *out.values()], kinds, strict=True)], names=["_p", *out])

    placed = texts.select(F.pmod("key", F.lit(parts)).cast("int").alias("_p"), "id", "key", "_text")
    store = checkpoint(cogrouped(placed, ranges, cut_regions, REGIONS))
    release(spark)

    first_keys = [f"k{q}" for q in range(-(-reach // 2))]
    wide = reach // 2  # columns of two words each in the bounds
    share = min(1.0, 3000 / max(1, store.count()))  # a sample for balance only
    sample = store.where(F.pmod(F.xxhash64("key", "start"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.substring("words", 1, 400).alias("w")).collect()
    found_keys = []
    for r in sample:
        w = [int(x) for x in np.frombuffer(r["w"], np.uint32)]
        found_keys += [tuple(w[j + 2 * q] << 32 | w[j + 2 * q + 1] for q in range(wide)) for j in range(0, len(w) - 2 * wide, 5)]
    found_keys.sort()
    bounds = np.array([found_keys[len(found_keys) * i // parts] for i in range(1, parts)] if found_keys else [], np.uint64).reshape(-1, wide)

    first_dtype = np.dtype([(k, "<u8") for k in first_keys] + [("part", "<i4"), ("at", "<i4")])

    def first_triples(table: pa.Table) -> pa.Table:
        text = Text(table, room)
        r = np.empty(len(text.sampled), first_dtype)
        for q, k in enumerate(first_keys):
            r[k] = text.packed(text.sampled, 2 * q, min(2, reach - 2 * q))
        r["part"], r["at"] = table.column("_p")[0].as_py(), text.sampled
        return scatter_table(text.part(text.sampled, bounds), r)

    def name_with(dtype: np.dtype, keys: list[str]):
        def run(table: pa.Table) -> pa.Table:
            blocks, unique = dense_names(gather(table, dtype), keys, table.column("_p")[0].as_py())
            return blocks.append_column("_u", pa.array([unique] * len(blocks)))

        return run

    named = "_p int, _d binary, _u boolean"
    names = checkpoint(grouped(grouped(store, first_triples), name_with(first_dtype, first_keys), named))
    release(spark)

    def triples_at(one: int, two: int):
        def next_triples(left: pa.Table, right: pa.Table) -> pa.Table:
            text = Text(left, room)
            rank = ranks(text, right)
            r = np.empty(len(text.sampled), TRIPLE)
            r["a"], r["b"], r["c"] = rank[text.sampled], at_or_zero(rank, text, one), at_or_zero(rank, text, two)
            r["part"], r["at"] = left.column("_p")[0].as_py() if len(left) else 0, text.sampled
            return scatter_table((r["a"] >> np.uint64(36)).astype(np.int64), r)

        return next_triples

    while reach < cover and not names.agg(F.coalesce(F.bool_and("_u"), F.lit(True))).first()[0]:
        one, two = next_shifts(reach, cover)
        triples = cogrouped(store, names.select("_p", "_d"), triples_at(one, two))
        names = checkpoint(grouped(triples, name_with(TRIPLE, ["a", "b", "c"]), named))
        release(spark)
        reach += two

    def suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
        text = Text(left, room)
        rank = ranks(text, right)
        at = np.flatnonzero(text.state)
        residue = text.pos[at] % 3
        r = np.empty(len(at), SUFFIX)
        r["words"], r["last"] = text.packed(at, 0), text.packed(at, length - 2)
        r["x"] = np.where(residue == 0, rank[at + 1], rank[at])
        r["y"] = np.where(residue == 1, rank[at + 1], rank[at + 2])
        r["id"], r["key"], r["at"], r["residue"], r["sure"] = text.ids[text.region[at]], text.keys[text.region[at]], text.pos[at], residue, text.state[at] == 2
        return scatter_table(text.part(at, bounds), r)

    def compare(table: pa.Table) -> pa.Table:
        f = adjacent(gather(table, SUFFIX))
        return scatter_table(f["key"] % parts, f)

    found = checkpoint(grouped(cogrouped(store, names.select("_p", "_d"), suffixes), compare))
    release(spark)

    def conclude(left: pa.Table, right: pa.Table) -> pa.Table:
        r = gather(left, RANGE)
        r = r[r["kind"] == SETTLED]
        span = r["span"].astype(np.int64) + 1
        settled = np.empty(int(span.sum()), FOUND)
        settled["id"], settled["key"], settled["first"] = np.repeat(r["id"], span), np.repeat(r["key"], span), 0
        settled["at"] = np.repeat(r["at"], span) + (np.arange(len(settled)) - np.repeat(np.cumsum(span) - span, span))
        out = intervals(np.concatenate([settled, gather(right, FOUND)]), length)
        ids = pa.array(out["id"], pa.int64(), mask=out["key"] & 1 == 1)
        return pa.Table.from_arrays([ids, pa.array(out["key"]), pa.array(out["start"]), pa.array(out["n"]), pa.array(out["first"] == 1)], names=["_id", "_key", "start_word", "n_words", "first"])

    result = cogrouped(ranges, found, conclude, "_id bigint, _key bigint, start_word int, n_words int, first boolean")
    return result.withColumnsRenamed({"_id": id_col, "_key": "text_key" if id_col.lower() != "text_key" else "_text_key"})


def ranks(text: Text, names: pa.Table) -> np.ndarray:
    r = gather(names, NAME)
    out = np.zeros(len(text.words), np.uint64)
    out[r["at"]] = r["name"]
    return out


def at_or_zero(rank: np.ndarray, text: Text, shift: int) -> np.ndarray:
    """Names ``shift`` further on in the same region, 0 beyond its end."""
    at = text.sampled + shift
    inside_ = at < len(rank)
    at = np.minimum(at, len(rank) - 1)
    same = inside_ & (text.pos[at] == text.pos[text.sampled] + shift) & (text.region[at] == text.region[text.sampled])
    return np.where(same, rank[at], np.uint64(0))


WORD = re.compile(r"\S+")


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """``text`` less the words ``start .. start + n - 1`` of each cut, and the space behind them."""
    spans = [m.span() for m in WORD.finditer(text)]
    gone = np.zeros(len(spans), bool)
    for s, n in cuts:
        gone[s : s + n] = True
    out, at = [], 0
    for k, (s, _) in enumerate(spans):
        nxt = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        if gone[k]:
            out.append(text[at:s])
            at = nxt
    out.append(text[at:])
    return "".join(out).strip() if gone.any() else text


def drop_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", max_broadcast: int = 500_000) -> DataFrame:
    """The rows with their columns, every repeated passage left only where it
    occurs first; rows of which nothing is left go.  ``chars_col``, where given
    and present, is set to the new length of changed texts."""
    cuts = repeats(docs, min_words, id_col, text_col).where("not first")
    cut_id, cut_list = free_name(docs, "_cut_id"), free_name(docs, "_cuts")
    cuts = checkpoint(cuts.groupBy(quoted(cuts.columns[1]).alias(cut_id)).agg(F.collect_list(F.struct("start_word", "n_words")).alias(cut_list)))
    cuts = F.broadcast(cuts) if cuts.count() <= max_broadcast else cuts
    columns = docs.columns
    text_at, chars_at = columns.index(text_col), columns.index(chars_col) if chars_col in columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, f"c{text_at}")):
            some = batch.column(len(columns))
            at = np.flatnonzero(np.asarray(some.is_valid().to_numpy(zero_copy_only=False)))
            if not len(at):
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=columns)
                continue
            texts, lists = batch.column(text_at).to_pylist(), some.take(pa.array(at)).to_pylist()
            keep, chars = np.ones(len(batch), bool), None if chars_at is None else batch.column(chars_at).to_pylist()
            for k, cs in zip(at.tolist(), lists, strict=True):
                if texts[k] is None:
                    continue
                new = without(texts[k], [(c["start_word"], c["n_words"]) for c in cs])
                keep[k] = bool(new.strip())
                if new != texts[k] and chars is not None:
                    chars[k] = len(new)
                texts[k] = new
            arrays = batch.columns[:-1]
            arrays[text_at] = pa.array(texts, pa.string())
            if chars is not None:
                arrays[chars_at] = pa.array(chars, batch.column(chars_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

    joined = docs.join(cuts, text_key(id_col, text_col) == F.col(cut_id), "left").select(*[quoted(c) for c in columns], cut_list)
    return map_rows(joined, cut, docs.schema)
