"""Graph operators over an edge table ``src, dst`` ("src depends on dst").

Iterative ones materialise each round in the checkpoint folder.  Null ends are
ignored; parallel edges count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators._session import checkpoint


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, dependency_count, dependent_count``."""
    e = clean(edges)
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("dependency_count"), F.sum("i").alias("dependent_count"))


def entry_points(edges: DataFrame) -> DataFrame:
    e = edges.select("dst").where("dst is not null").distinct()
    return nodes(edges).join(e, F.col("node") == e["dst"], "left_anti")


def leaf_nodes(edges: DataFrame) -> DataFrame:
    e = edges.select("src").where("src is not null").distinct()
    return nodes(edges).join(e, F.col("node") == e["src"], "left_anti")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degree over (number of nodes - 1), a self-loop counting twice; 1 for a single node."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n_nodes"))
    joined = d.crossJoin(F.broadcast(n))
    degree = F.col("dependency_count") + F.col("dependent_count")
    return joined.select("node", F.when(F.col("n_nodes") > 1, degree / (F.col("n_nodes") - 1)).otherwise(F.lit(1.0)).alias("centrality"))


def transitive_closure(edges: DataFrame, max_rounds: int = 40, max_broadcast: int = 8_000_000) -> DataFrame:
    """All pairs with a path.

    Up to ``max_broadcast`` edges are sent to all tasks, which walk from their
    nodes and shuffle nothing.  More are joined in doubling rounds, logarithmic in the longest path, in
    which only pairs at exactly half the distance meet."""
    e = checkpoint(clean(edges))
    if e.count() <= max_broadcast:
        return _walked(e)
    exact = known = e  # shortest walks of 2 ** round edges, and of up to 2 ** (round + 1) - 1
    for _ in range(max_rounds):
        exact = checkpoint(_composed(exact, exact).distinct().join(known, ["src", "dst"], "left_anti"))
        if exact.isEmpty():
            return known
        known = checkpoint(known.union(exact).union(_composed(exact, known)).distinct())
    raise RuntimeError("the closure didn't settle")


def _composed(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.toDF("src", "via").join(b.toDF("via", "dst"), "via").select("src", "dst")


def _walked(edges: DataFrame, cells: int = 64_000_000, rows: int = 1_000_000) -> DataFrame:
    """The closure by breadth-first walks, several nodes of a task at once; ``cells``
    bounds the marks of a task, ``rows`` what is held before it is given out."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    graph = _Adjacency(edges.toArrow())
    n = len(graph.labels)
    if not n:
        return edges
    shared = spark.sparkContext.broadcast((graph.labels, graph.first, graph.targets))
    group = max(1, cells // n)

    def given(labels: pa.Array, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        src, dst = (np.concatenate(x) for x in zip(*held, strict=True))
        for k in range(0, len(src), rows):
            yield pa.record_batch({"src": labels.take(pa.array(src[k : k + rows])), "dst": labels.take(pa.array(dst[k : k + rows]))})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, first, targets = shared.value
        degree = np.diff(first)
        seen = np.zeros(group * n, bool)
        for batch in batches:
            sources = batch.column(0).to_numpy()
            for at in range(0, len(sources), group):
                some = sources[at : at + group]
                seen[:] = False
                line, node = np.arange(len(some)), some
                held: list[tuple[np.ndarray, np.ndarray]] = []
                size = 0
                while len(node):
                    if widest == 1:
                        more = np.flatnonzero(degree[node])
                        line, node = line[more], targets[first[node[more]]]
                        mark = line * n + node
                        new = np.flatnonzero(~seen[mark])
                        line, node = line[new], node[new]
                        seen[mark[new]] = True
                        held.append((some[line], node))
                        size += len(node)
                        if size >= rows or not len(node):
                            yield from given(labels, held)
                            held, size = [], 0
                        continue
                    found = []
                    total = int(degree[node].sum())
                    for l, v in zip(*(np.array_split(x, -(-total // rows) or 1) for x in (line, node)), strict=True):
                        d = degree[v]
                        up = np.cumsum(d)
                        to = targets[np.repeat(first[v] - up + d, d) + np.arange(up[-1] if len(up) else 0)]
                        mark = np.repeat(l * n, d) + to
                        mark = mark[~seen[mark]]
                        mark = np.unique(mark)
                        seen[mark] = True
                        found.append(mark)
                    marks = np.concatenate(found)
                    line, node = np.divmod(marks, n)
                    held.append((some[line], node))
                    size += len(node)
                    if size >= rows or not len(node):
                        yield from given(labels, held)
                        held, size = [], 0

    widest = int(np.diff(graph.first).max())
    parts = max(1, min(-(-n // 64), 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInArrow(reach, f"src {kind}, dst {kind}")


def strongly_connected(edges: DataFrame, task_edges: int = 1_000_000) -> DataFrame:
    """``node, component, size``: the least node of those it reaches and is reached from.

    Edges that can't be on a cycle are trimmed in rounds, and what trimming
    leaves is split by colours, until ``task_edges`` remain, which one task settles."""
    core = _components(checkpoint(clean(edges).where("src <> dst")), task_edges)
    core = core.join(core.groupBy("component").agg(F.count("*").alias("size")), "component")
    own = nodes(edges).join(core, "node", "left")
    return own.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1).cast("bigint")).alias("size"))


def _components(rest: DataFrame, task_edges: int) -> DataFrame:
    """``node, component`` of the components of more than one node."""
    found, count = [], rest.count()
    while count > task_edges:
        heads, tails = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
        trimmed = checkpoint(rest.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        left = trimmed.count()
        if left > 0.95 * count:
            members, trimmed = _colour(trimmed)
            found.append(members)
            left = trimmed.count()
        rest, count = trimmed, left
    kind = rest.schema["src"].dataType.simpleString()
    out = rest.groupBy().applyInArrow(_tarjan, f"node {kind}, component {kind}")
    for members in found:
        out = out.union(members)
    return checkpoint(out)


def _colour(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node takes the least node that reaches it as its colour.  Those of a
    colour that reach that node are its component; edges between colours and at settled nodes go."""
    colour = checkpoint(nodes(edges).withColumn("colour", F.col("node")))
    fresh = colour
    while not fresh.isEmpty():
        offer = edges.join(fresh, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        both = colour.join(offer, "node", "left")
        both = checkpoint(both.select("node", F.least("colour", "offer").alias("colour"), F.coalesce(F.col("offer") < F.col("colour"), F.lit(False)).alias("changed")))
        colour, fresh = both.select("node", "colour"), both.where("changed").select("node", "colour")
    a, b = colour.toDF("src", "colour"), colour.toDF("dst", "cb")
    inner = checkpoint(edges.join(a, "src").join(b, "dst").where("colour = cb").select("src", "dst", "colour"))
    members = fresh = checkpoint(colour.where("node = colour"))
    while not fresh.isEmpty():
        back = inner.join(fresh.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
        fresh = checkpoint(back.join(members.select("node"), "node", "left_anti"))
        members = checkpoint(members.union(fresh))
    settled = members.select("node")
    rest = inner.join(settled.toDF("src"), "src", "left_anti").join(settled.toDF("dst"), "dst", "left_anti")
    large = members.join(members.where("node <> colour").select("colour").distinct(), "colour", "left_semi")
    return checkpoint(large.select("node", F.col("colour").alias("component"))), checkpoint(rest.select("src", "dst"))


def _tarjan(table: pa.Table) -> pa.Table:
    graph = _Adjacency(table)
    first, targets = graph.first.tolist(), graph.targets.tolist()
    n = len(first) - 1
    index, low, at = [0] * n, [0] * n, first[:-1]
    closed, open_, clock = bytearray(n), [], 0
    members, sizes = [], []
    for root in range(n):
        if index[root]:
            continue
        call = [root]
        while call:
            v = call[-1]
            if not index[v]:
                clock += 1
                index[v] = low[v] = clock
                open_.append(v)
            if at[v] < first[v + 1]:
                w = targets[at[v]]
                at[v] += 1
                if not index[w]:
                    call.append(w)
                elif not closed[w]:
                    low[v] = min(low[v], index[w])
                continue
            call.pop()
            if call:
                low[call[-1]] = min(low[call[-1]], low[v])
            if low[v] == index[v]:
                k = len(open_) - 1
                while open_[k] != v:
                    k -= 1
                for w in open_[k:]:
                    closed[w] = 1
                if len(open_) - k > 1:
                    members += open_[k:]
                    sizes.append(len(open_) - k)
                del open_[k:]
    node = graph.labels.take(pa.array(members, pa.int64()))
    number = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    least = pa.table({"node": node, "number": number}).group_by("number").aggregate([("node", "min")]).sort_by("number")
    return pa.table({"node": node, "component": least["node_min"].combine_chunks().take(number)})


class _Adjacency:
    """Edges with nodes numbered: targets of node ``v`` are ``targets[first[v]:first[v + 1]]``."""

    def __init__(self, edges: pa.Table) -> None:
        ends = pa.chunked_array(edges["src"].chunks + edges["dst"].chunks, edges.schema.field("src").type).combine_chunks()
        coded = ends.dictionary_encode()
        self.labels = coded.dictionary
        number = coded.indices.to_numpy(zero_copy_only=False)
        src, dst = number[: edges.num_rows], number[edges.num_rows :]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(self.labels)))])
        self.targets = dst[np.argsort(src, kind="stable")]


def cycles(edges: DataFrame, max_length: int = 64, max_paths: int = 1_000_000) -> DataFrame:
    """Every simple cycle once, from its least node: ``cycle, length``.

    Inside each strongly connected component, runs of nodes with one edge in and
    one out become single steps (a task a component); paths grow over the nodes
    where edges part or meet, from the least of them.  Raises where a cycle of more than ``max_length``
    nodes, or more than ``max_paths`` open paths, would have to be followed."""
    e = clean(edges)
    kind = e.schema["src"].dataType.simpleString()
    loops = e.where("src = dst").select(F.array("src").alias("cycle"))
    scc = checkpoint(strongly_connected(e).where("size > 1"))
    a, b = scc.select(F.col("node").alias("src"), F.col("component").alias("ca")), scc.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    core = e.where("src <> dst").join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "ca")
    steps = checkpoint(core.groupBy("ca").applyInArrow(_runs, f"src {kind}, dst {kind}, run array<{kind}>"))
    found = []
    paths = steps.select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("seen"), F.col("run").alias("path"))
    while True:
        paths = checkpoint(paths.where("last >= first"))
        closed, open_ = paths.where("last = first"), paths.where("last > first")
        n, longest = paths.agg(F.count(F.when(F.col("last") > F.col("first"), 1)), F.max(F.size("path") + (F.col("last") > F.col("first")).cast("int"))).first()
        if longest is not None and longest > max_length + 1:
            raise ValueError("cycles longer than max_length")
        if n > max_paths:
            raise ValueError("too many paths; lower max_length or split the graph")
        found.append(closed.select("path"))
        if not n:
            break
        grown = open_.join(steps, F.col("last") == F.col("src")).where(~F.array_contains("seen", F.col("dst")) | (F.col("dst") == F.col("first")))
        paths = grown.select("first", F.col("dst").alias("last"), F.concat("seen", F.array("dst")).alias("seen"), F.concat("path", "run").alias("path"))
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    least = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", least, F.size("path")), F.slice("path", F.lit(1), least - 1))
    return loops.union(out.select(turned.alias("cycle"))).select("cycle", F.size("cycle").alias("length"))


def _runs(table: pa.Table) -> pa.Table:
    """``src, dst, run``: a walk from ``src`` to ``dst`` over nodes with one edge in and one out."""
    graph = _Adjacency(table)
    first, targets = graph.first.tolist(), graph.targets.tolist()
    out, into = np.diff(graph.first), np.bincount(graph.targets, minlength=len(first) - 1)
    between = ((out == 1) & (into == 1)).tolist()
    ends: tuple[list, list] = [], []
    walked, sizes = [], [0]
    for v in [v for v, inner in enumerate(between) if not inner] or [0]:
        for w in targets[first[v] : first[v + 1]]:
            walked.append(v)
            while between[w] and w != v:
                walked.append(w)
                w = targets[first[w]]
            sizes.append(len(walked))
            ends[0].append(v)
            ends[1].append(w)
    src, dst, run = (graph.labels.take(pa.array(x, pa.int64())) for x in (*ends, walked))
    return pa.table({"src": src, "dst": dst, "run": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), run)})


def dependency_levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node, level``: longest path to a leaf (0); nodes on or above cycles have none."""
    e = checkpoint(clean(edges))
    done = checkpoint(leaf_nodes(e).select("node", F.lit(0).alias("level")))
    rest = e
    for level in range(1, max_rounds):
        settled = done.where(F.col("level") == level - 1).select(F.col("node").alias("dst"))
        rest = checkpoint(rest.join(settled, "dst", "left_anti").select("src", "dst"))
        last = e.join(settled, "dst", "left_semi").select("src").distinct()
        new = checkpoint(last.join(rest.select("src").distinct(), "src", "left_anti").select(F.col("src").alias("node"), F.lit(level).alias("level")))
        if new.isEmpty():
            return done
        done = checkpoint(done.union(new))
    raise RuntimeError("too many levels")


def initialization_order(edges: DataFrame, dependencies_first: bool = False) -> DataFrame:
    """``position, node, component, rank``.  Cycles count as one node.  By default
    dependents come before what they depend on; nodes of a rank are ordered by component and name."""
    e = clean(edges)
    scc = checkpoint(strongly_connected(e).select("node", "component"))
    a, b = scc.select(F.col("node").alias("src"), F.col("component").alias("ca")), scc.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    condensed = e.join(a, "src").join(b, "dst").where("ca <> cb").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()
    towards = condensed if dependencies_first else condensed.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    levels = dependency_levels(towards).select(F.col("node").alias("component"), F.col("level").alias("rank"))
    ranked = scc.join(levels, "component", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    from plinth.operators.relational import numbered

    return numbered(ranked, "rank", "component", "node").select("position", "node", "component", "rank")


def sequence_edges(order: DataFrame, node: str = "node", position: str = "position") -> DataFrame:
    """Edges between neighbours of a sequence of consecutive positions."""
    nxt = order.select((F.col(position) - 1).alias("_p"), F.col(node).alias("dst"))
    return order.join(nxt, F.col(position) == F.col("_p")).select(F.col(position), F.col(node).alias("src"), "dst")


def reverse_graph(edges: DataFrame) -> DataFrame:
    """``node, dependents``: who depends on each node."""
    return clean(edges).groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))


def typed_nodes(priority: list[tuple[DataFrame, str, int]], name: str = "name") -> DataFrame:
    """Union of node tables; of rows with the same name the least priority number stays."""
    out = None
    for df, kind, p in priority:
        part = df.select(F.col(name), F.lit(kind).alias("node_type"), F.lit(p).alias("_p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(name).agg(F.min_by("node_type", F.struct("_p", "node_type")).alias("node_type"))
