"""Hidden Markov language model: distributed Baum-Welch, exact scaled forward scores.

A document is the sequence of its normalised words, each known by its whole 64-bit
hash.  Documents are put in chunks of about ``CHUNK`` words, each with its own
vocabulary.  The emission table has a row a distinct word of the corpus and is
never in one place: each chunk sends the expected counts of its words to the
parts of a hash range, where they are summed and sent back to the chunks that hold the
word, so that what is gathered and kept grows with the corpus and its vocabulary.  The
number of parts follows the vocabularies' size.  Symbols and messages travel by byte planes,
compressed; each step's messages replace those before, so that the disk holds the chunks
and those of two steps.  Only the sums of a fixed number
of columns (starts, moves, occupancy of states, log-likelihood) reach the driver.

Training cuts documents into segments of ``segment`` words, all of which are used, and
stops after ``rounds`` re-estimations, or before where the log-likelihood gains
less than ``tolerance`` of itself.  A re-estimated emission is the expected count with
``smoothing`` of the words' own frequencies, so that each state's row sums to 1 over
the words of the corpus.  Scoring runs the scaled forward recursion over each whole
document, so that the likelihood is that of the whole sequence, exactly.

Nulls, ties, odd input: a null or empty text has no words, log-likelihood 0 and
a null ``per_word``; a null id is scored like any other; repeated rows count and
are scored each; a text longer than a chunk is a chunk of its own, trained on in
slices; other columns are never read.  An empty table, or one without words, gives
no model to train and an empty result, or zeros.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._text import BASE, mix, pieces, word_codes
from plinth.llm._util import checkpoint, ensure_checkpoint_dir, quoted, shuffle_partitions
from plinth.llm.blocks import release

CHUNK = 1 << 21  # words
SLICE = 1 << 20  # words of a chunk in one forward-backward recursion
PART = 1 << 20  # rows of chunk vocabularies in a part


@dataclass
class Model:
    start: np.ndarray  # [states]
    move: np.ndarray  # [states, states]
    emit: np.ndarray  # [symbols, states]; each column sums to 1


@dataclass
class Estimate:
    """What turns summed counts of a word into its emissions; of fixed size."""

    start: np.ndarray
    move: np.ndarray
    total: float  # words of the corpus
    norm: np.ndarray  # [states]: sum of the emission counts over all words
    mass: float | None  # words' worth of the words' own frequencies; None: frequencies tilted at random


def tilt(words: np.ndarray, states: int) -> np.ndarray:
    """A number from 0.5 to 1.5 for each word and state, the same wherever the word is."""
    seeds = (np.arange(1, states + 1, dtype=np.uint64) * BASE)[None]
    return 0.5 + (mix(mix(words[:, None] ^ seeds)) >> np.uint64(11)) * 2.0**-53


def emissions(e: Estimate, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Emissions of words from their summed ``[occurrences, expected by state ...]``."""
    share = counts[:, :1] / max(e.total, 1.0)
    if e.mass is None:
        return share * tilt(words, len(e.start)) / e.norm
    return (counts[:, 1:] + e.mass * share) / (e.norm + e.mass)


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: (order of rows, rows active at each step, first index of each step)."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(lengths) else 0
    active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest] if longest else np.zeros(0, np.int64)
    return order, active, np.concatenate([[0], np.cumsum(active)])


def layout(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in time-major order with (order, active, first)."""
    lengths = np.diff(offsets)
    order, active, first = time_major(lengths)
    if not len(active):
        return symbols[:0], order, active, first
    starts = offsets[:-1][order]
    step = np.repeat(np.arange(len(active)), active)
    rank = np.arange(first[-1]) - first[step]
    return symbols[starts[rank] + step], order, active, first


def forward(model: Model, symbols: np.ndarray, offsets: np.ndarray, keep: bool = False):
    """Log-likelihood of each row; with ``keep`` also the scaled alphas and the layout."""
    flat, order, active, first = layout(symbols, offsets)
    likelihood = np.zeros(len(offsets) - 1)
    if not len(active):
        return (likelihood, None) if keep else likelihood
    emit, move = model.emit, model.move
    alphas = np.empty((len(flat), len(model.start))) if keep else None
    total = np.zeros(active[0])
    alpha = np.broadcast_to(model.start, (active[0], len(model.start)))
    scales = np.empty(len(flat)) if keep else None
    for t, n in enumerate(active):
        at = first[t]
        alpha = (alpha if t == 0 else alpha[:n] @ move) * emit[flat[at : at + n]]
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log(scale)
        if keep:
            alphas[at : at + n], scales[at : at + n] = alpha, scale
    likelihood[order[: active[0]]] = total
    return (likelihood, (flat, order, active, first, alphas, scales)) if keep else likelihood


def expected(model: Model, symbols: np.ndarray, offsets: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log-likelihood."""
    states = len(model.start)
    likelihood, kept = forward(model, symbols, offsets, keep=True)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states))
    if kept is None:
        return start, move, emit, 0.0
    flat, _, active, first, alphas, scales = kept
    beta = np.ones((0, states))
    for t in range(len(active) - 1, -1, -1):
        n, at = active[t], first[t]
        new = np.ones((n, states))
        if len(beta):
            m = len(beta)
            nxt = first[t + 1]
            ahead = beta * model.emit[flat[nxt : nxt + m]] / scales[nxt : nxt + m, None]
            move += model.move * (alphas[at : at + m].T @ ahead)
            new[:m] = ahead @ model.move.T
        beta = new
        alphas[at : at + n] *= beta  # the posterior from here on
    start += alphas[: active[0]].sum(0)
    for k in range(states):
        emit[:, k] = np.bincount(flat, alphas[:, k], n_symbols)
    return start, move, emit, float(likelihood.sum())


def segments(offsets: np.ndarray, length: int) -> np.ndarray:
    """Offsets with every row cut into pieces of at most ``length``."""
    sizes = np.diff(offsets)
    n = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.append(offsets[:-1][row] + k * length, offsets[-1])


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as compressed byte planes: the high bytes of small numbers,
    and the exponents of floats, take little room."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in map(np.ascontiguousarray, columns)]
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd").compress(b"".join(planes), asbytes=True)


def unpack(data: pa.Buffer, *kinds: str) -> list[np.ndarray]:
    """The columns of ``pack``, given their types."""
    n, sizes = int.from_bytes(data[:8].to_pybytes(), "little"), [np.dtype(k).itemsize for k in kinds]
    if not n:
        return [np.empty(0, k) for k in kinds]
    flat, out, at = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * sum(sizes)), np.uint8), [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, words: int = CHUNK) -> DataFrame:
    """``_c, _n, _ids, _ends, _symbols, _vocab``: a row a chunk, the symbols being places in its vocabulary."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            symbols, vocab = pd.factorize(np.concatenate([c for _, c, _ in held]))
            ids = pa.chunked_array([i for i, _, _ in held]).combine_chunks()
            ends = np.cumsum(np.concatenate([n for _, _, n in held]))
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            columns = [pa.array([number]), pa.array([len(vocab)], pa.int64()), lists, _binary(ends.astype("<i8")), pa.array([pack(symbols.astype("<u4"))], pa.binary()), _binary(vocab.astype("<u8"))]
            return pa.RecordBatch.from_arrays(columns, names=["_c", "_n", "_ids", "_ends", "_symbols", "_vocab"])

        for batch in (piece for whole in batches for piece in pieces(whole, "_text")):
            codes, offsets = word_codes(batch.column("_text"))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + words - size, "right")) - 1)
                held.append((batch.column("_id").slice(lo, hi - lo), codes[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1])))
                size += int(offsets[hi] - offsets[lo])
                lo = hi
                if size >= words or lo < len(batch):
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    made = docs.select(quoted(id_col).alias("_id"), quoted(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"_c bigint, _n bigint, _ids array<{kind}>, _ends binary, _symbols binary, _vocab binary"
    )
    return made.repartition(shuffle_partitions(docs.sparkSession), "_c").sortWithinPartitions("_c")  # later cogroups find them in place


def settled(chunked: DataFrame) -> DataFrame:
    """Checkpoint of the chunks that keeps their partitioning and order, which that of an
    adaptive plan doesn't, so that no round shuffles them again."""
    conf = chunked.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(chunked)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


class Rounds:
    """The messages of each step, written in the shared folder in place of those before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{ensure_checkpoint_dir(spark)}/hmm-{uuid.uuid4().hex}", 0

    def write(self, messages: DataFrame) -> DataFrame:
        self.n += 1
        messages.write.parquet(f"{self.folder}/{self.n}", compression="uncompressed")  # the blocks are compressed
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.n - 1}")
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        for _ in range(2):  # a plan that has just ended is still held by its events, and with it its shuffle
            release(self.spark)
            time.sleep(0.3)
        return self.spark.read.schema(messages.schema).parquet(f"{self.folder}/{self.n}")


UP = "_p int, _c bigint, _d binary, _h array<double>"


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, offsets and vocabulary of a chunk."""
    get = lambda name, kind: np.frombuffer(table.column(name)[0].as_buffer(), kind)
    vocab = get("_vocab", "<u8")
    return unpack(table.column("_symbols")[0].as_buffer(), "<u4")[0].astype(np.int64), np.concatenate([[0], get("_ends", "<i8")]), vocab


UP_KINDS, BACK_KINDS = ("<u8", "<u4", "<u4"), ("<u4", "<u8")  # words, places (as steps) and occurrences; places and occurrences


def _send(chunk: int, vocab: np.ndarray, counts: np.ndarray, head: np.ndarray, parts: int) -> pa.Table:
    """The counts of a chunk's words, a block a part, and its sums as part -1."""
    part = (mix(vocab) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")  # within a part by place
    part, words, occurrences, by_state = part[order], vocab[order], counts[order, 0].astype("<u4"), counts[order, 1:].T.astype("<f4")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    blocks = [None, *(pack(words[a:b], np.diff(order[a:b], prepend=0).astype("<u4"), occurrences[a:b], *by_state[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
    heads = [head.tolist()] + [None] * (len(blocks) - 1)
    to = np.concatenate([[-1], part[cuts[:-1]]]).astype(np.int32)
    return pa.table({"_p": to, "_c": np.full(len(to), chunk), "_d": pa.array(blocks, pa.binary()), "_h": pa.array(heads, pa.list_(pa.float64()))})


def _sums(up: DataFrame, width: int) -> np.ndarray:
    row = up.where("_p = -1").agg(*[F.sum(F.col("_h")[k]).alias(f"h{k}") for k in range(width)]).first()
    return np.array([x or 0.0 for x in row])


def _back(up: DataFrame, states: int) -> DataFrame:
    """``_c, _d``: to each chunk the counts of its words, summed over all chunks."""

    def add(table: pa.Table) -> pa.Table:
        blocks = [unpack(x.as_buffer(), *UP_KINDS, *["<f4"] * states) for chunk in table.column("_d").chunks for x in chunk]
        back, words = pd.factorize(np.concatenate([b[0] for b in blocks]))
        total = [np.bincount(back, np.concatenate([b[k] for b in blocks]), len(words)).astype("<u8" if k == 2 else "<f4") for k in range(2, 3 + states)]
        ends = np.cumsum([len(b[0]) for b in blocks])
        out = [pack(b[1], *[t[back[end - len(b[0]) : end]] for t in total]) for b, end in zip(blocks, ends, strict=True)]
        return pa.table({"_c": table.column("_c"), "_d": pa.array(out, pa.binary())})

    return up.where("_p >= 0").select("_p", "_c", "_d").groupBy("_p").applyInArrow(add, "_c bigint, _d binary")


def _counts(table: pa.Table, n: int, states: int) -> np.ndarray:
    out = np.zeros((n, 1 + states))
    for chunk in table.column("_d").chunks:
        for x in chunk:
            steps, *counts = unpack(x.as_buffer(), *BACK_KINDS, *["<f4"] * states)
            out[np.cumsum(steps, dtype=np.int64)] = np.stack(counts, 1)
    return out


def count_words(chunked: DataFrame, states: int, parts: int) -> DataFrame:
    """The first message of each chunk: occurrences of its words."""

    def run(table: pa.Table) -> pa.Table:
        symbols, _, vocab = _unpack(table)
        counts = np.zeros((len(vocab), 1 + states))
        counts[:, 0] = np.bincount(symbols, minlength=len(vocab))
        head = np.append(counts[:, 0] @ tilt(vocab, states), len(symbols))
        return _send(table.column("_c")[0].as_py(), vocab, counts, head, parts)

    return chunked.select("_c", "_ends", "_symbols", "_vocab").groupBy("_c").applyInArrow(run, UP)


def chunk_counts(model: Model, symbols: np.ndarray, offsets: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected emissions of a chunk, and its sums: starts, moves, occupancy, log-likelihood."""
    cut = segments(offsets, segment)
    emit, states, lo = np.zeros_like(model.emit), len(model.start), 0
    head = np.zeros(2 * states + states * states + 1)
    while lo < len(cut) - 1:
        hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + SLICE, "right")) - 1)
        start, move, e, likelihood = expected(model, symbols[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo], len(emit))
        emit += e
        head += np.concatenate([start, move.ravel(), e.sum(0), [likelihood]])
        lo = hi
    return emit, head


def expect(chunked: DataFrame, back: DataFrame, e: Estimate, segment: int, parts: int) -> DataFrame:
    """One round: the next message of each chunk."""
    states = len(e.start)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        symbols, offsets, vocab = _unpack(left)
        emit = emissions(e, vocab, _counts(right, len(vocab), states))
        counts, head = chunk_counts(Model(e.start, e.move, emit), symbols, offsets, segment)
        counts = np.column_stack([np.bincount(symbols, minlength=len(vocab)), counts])
        return _send(left.column("_c")[0].as_py(), vocab, counts, head, parts)

    used = chunked.select("_c", "_ends", "_symbols", "_vocab")
    return used.groupBy("_c").cogroup(back.groupBy("_c")).applyInArrow(run, UP)


def train(chunked: DataFrame, states: int = 6, rounds: int = 3, segment: int = 256, smoothing: float = 0.01, tolerance: float = 1e-4) -> tuple[Estimate, DataFrame, list[float]]:
    """The estimate, the summed counts sent to each chunk (with it the
    model) and the log-likelihood before each re-estimation."""
    vocabularies = chunked.agg(F.sum("_n")).first()[0] or 0
    parts = -(-vocabularies // PART) or 1
    messages = Rounds(chunked.sparkSession)
    up = messages.write(count_words(chunked, states, parts))
    sums = _sums(up, states + 1)
    back = messages.write(_back(up, states))
    rng = np.random.default_rng(11)
    move, total = rng.uniform(0.5, 1.5, (states, states)), float(sums[-1])
    e = Estimate(np.full(states, 1 / states), move / move.sum(1, keepdims=True), total, sums[:-1] / total if total else np.ones(states), None)
    trace: list[float] = []
    for _ in range(rounds if total else 0):
        up = messages.write(expect(chunked, back, e, segment, parts))
        sums = _sums(up, 2 * states + states * states + 1)
        back = messages.write(_back(up, states))
        start, move, norm = sums[:states] + 1.0, sums[states : states + states * states].reshape(states, states) + 1.0, sums[-1 - states : -1]
        e = Estimate(start / start.sum(), move / move.sum(1, keepdims=True), total, norm, smoothing * total / states)
        trace.append(float(sums[-1]))
        if len(trace) > 1 and trace[-1] - trace[-2] < tolerance * abs(trace[-2]):
            break
    return e, back, trace


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 6, rounds: int = 3, segment: int = 256, smoothing: float = 0.01, tolerance: float = 1e-4) -> DataFrame:
    """Train on all documents and score each: ``id, n_words, log_likelihood, per_word``."""
    if states < 1 or rounds < 0 or smoothing < 0:
        raise ValueError("states >= 1, rounds >= 0 and smoothing >= 0")
    chunked = settled(chunks(docs, id_col, text_col))
    e, back, _ = train(chunked, states, rounds, segment, smoothing, tolerance)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        symbols, offsets, vocab = _unpack(left)
        model = Model(e.start, e.move, emissions(e, vocab, _counts(right, len(vocab), states)))
        n, likelihood = np.diff(offsets), forward(model, symbols, offsets)
        mean = pa.array(likelihood / np.maximum(n, 1), mask=n == 0)
        return pa.table({"_id": left.column("_ids").combine_chunks().flatten(), "n_words": n, "log_likelihood": likelihood, "per_word": mean})

    scored = chunked.drop("_n").groupBy("_c").cogroup(back.groupBy("_c")).applyInArrow(run, f"_id {kind}, n_words bigint, log_likelihood double, per_word double")
    return scored.withColumnRenamed("_id", id_col)
