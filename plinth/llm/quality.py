"""Quality rules by robust multivariate outliers.

Each document is a vector of transformed text statistics (``FEATURES``).  For
every language and source a minimum-covariance-determinant estimate is made from
several starts: coordinate-wise medians and median deviations, and ``starts - 1``
small subsets of documents chosen by hash.  From each, concentration steps keep
the share ``support`` of least Mahalanobis distance and re-estimate mean and
covariance on it, which never raises the covariance's determinant; of the starts
the one with the least determinant is kept.  A last step reweighs by the chi-square
quantile.  Distances are scaled so that a group's median is the chi-square median,
and a document beyond the ``cutoff`` quantile times ``inflation`` (tails of texts
are heavier than normal ones) is rejected.

All sums and quantiles are distributed aggregates over all documents; what is
joined back is one row a group, broadcast up to ``max_broadcast`` groups.  The
statistics are in units of what counts as a trifle, and the covariance gets
``ridge``**2 on its diagonal, so that one that hardly varies in a group doesn't
reject for less.

Nulls, ties, odd input: a null or empty text has the statistics of an empty
text, a very long one is read whole; a null language or source is a value of its own; groups of fewer than
``min_group`` documents use their language's estimate, languages of fewer the
one of all documents, and if all are fewer nothing is rejected (distance null);
repeated rows count each, starts of equal determinant go by number.  An empty
table gives an empty result; other columns are never read, whatever their names.
Result: id, language, source, ``distance`` (squared), ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm._text import pieces, split_words
from plinth.llm._util import checkpoint, quoted

#: Statistic: the difference in its transformed value that is a trifle, and the unit of the vectors.
FEATURES = {"log_words": 1.0, "log_word_bytes": 0.1, "arc_punctuation": 0.05, "arc_upper": 0.05, "arc_digits": 0.07, "log_distinct_share": 0.08, "log_words_per_line": 1.0}
#: Bytes of usual text that shares and word lengths are smoothed by, so that those of short texts aren't noise.
SMOOTH = 300
KINDS = np.zeros(256, np.uint8)
for _c in range(256):
    KINDS[_c] = 1 if chr(_c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c == 10 else 0


def chi2_quantile(p: float, d: int) -> float:
    """Wilson-Hilferty approximation."""
    z = NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words, offsets = split_words(texts)
    n, d = len(texts), len(FEATURES)
    out = np.zeros((n, d))
    if not n:
        return out
    count = np.diff(offsets).astype(float)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    size = np.diff(bounds).astype(float)
    kind = KINDS[data[bounds[0] : bounds[-1]]]
    shares = {}
    for k in (1, 2, 3, 4):
        run = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        shares[k] = run[bounds[1:] - bounds[0]] - run[bounds[:-1] - bounds[0]]
    arc = lambda x, usual: np.arcsin(np.sqrt((x + usual * SMOOTH) / (size + SMOOTH)))
    lengths = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
    word_bytes = lengths[offsets[1:]] - lengths[offsets[:-1]]
    distinct = np.zeros(n)
    if len(words):
        code = np.asarray(words.dictionary_encode().indices).astype(np.int64)
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        pair = np.sort(row * (code.max() + 1) + code)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        distinct = np.bincount(pair[new] // (code.max() + 1), minlength=n).astype(float)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.log1p((word_bytes + 6 * SMOOTH / 10) / (count + SMOOTH / 10))
    out[:, 2], out[:, 3], out[:, 4] = arc(shares[1], 0.025), arc(shares[2], 0.02), arc(shares[3], 0.005)
    out[:, 5] = np.log1p(distinct) / np.log1p(np.maximum(count, 1))
    out[:, 6] = np.log1p(count / (shares[4] + 1.0))
    return out / np.array(list(FEATURES.values()))


def vectors(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_text")):
            x = statistics(batch.column("_text"))
            cols = [batch.column(c) for c in ("_id", "_lang", "_source")]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1])]], names=["_id", "_lang", "_source", *XS])

    picked = docs.select(quoted(id_col).alias("_id"), quoted(lang_col).cast("string").alias("_lang"), quoted(source_col).cast("string").alias("_source"), quoted(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, _lang string, _source string, " + ", ".join(f"{x} double" for x in XS))


D = len(FEATURES)
XS = [f"_x{j}" for j in range(D)]
SCHEMA = "_group string, _m array<double>, _p array<double>"


def with_groups(v: DataFrame, min_group: int) -> DataFrame:
    """Adds ``_group``: the finest of (language, source), language, all with enough documents."""
    name = lambda *c: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), x), F.lit("?")) for x in c])
    fine, coarse = name("_lang", "_source"), name("_lang")
    counts = v.groupBy(fine.alias("_f"), coarse.alias("_c")).count()
    by_lang = counts.groupBy("_c").agg(F.sum("count").alias("_nc"))
    total = counts.agg(F.sum("count").alias("_n"))
    label = F.when(F.col("count") >= min_group, F.concat(F.lit("s"), "_f")).when(F.col("_nc") >= min_group, F.concat(F.lit("l"), "_c")).when(F.col("_n") >= min_group, F.lit("all"))
    table = checkpoint(counts.join(by_lang, "_c").crossJoin(total).select("_f", label.alias("_group")))
    return v.withColumn("_f", fine).join(_hint(table, 20_000), "_f").drop("_f")


def _hint(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def _distances(v: DataFrame, params: DataFrame, most: int, kind: str) -> DataFrame:
    """``v`` with ``_d``, the squared Mahalanobis distance."""
    joined, columns = v.join(_hint(params, most), "_group"), v.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in XS])
            m = np.asarray(b.column("_m").flatten()).reshape(-1, D)
            p = np.asarray(b.column("_p").flatten()).reshape(-1, D, D)
            c = x - m
            d = np.einsum("ni,nij,nj->n", c, p, c)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in columns], pa.array(d)], names=[*columns, "_d"])

    return joined.select(*columns, "_m", "_p").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in v.dtypes) + ", _d double")


def _estimate(weighed: DataFrame, ridge: float) -> DataFrame:
    """Mean and inverse covariance of each group's rows."""
    sums = [F.sum(x).alias(f"s{j}") for j, x in enumerate(XS)]
    products = [F.sum(F.col(XS[i]) * F.col(XS[j])).alias(f"q{i}_{j}") for i in range(D) for j in range(i, D)]
    totals = weighed.groupBy("_group").agg(F.count("*").alias("n"), *sums, *products)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = np.array([r[f"s{j}"] for j in range(D)]) / r["n"]
                cov = np.empty((D, D))
                for i in range(D):
                    for j in range(i, D):
                        cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - m[i] * m[j]
                inverse = np.linalg.inv(cov + ridge**2 * np.eye(D))
                yield pa.RecordBatch.from_pylist([{"_group": r["_group"], "_m": m.tolist(), "_p": inverse.ravel().tolist()}], schema=ARROW)

    return checkpoint(totals.mapInArrow(invert, SCHEMA))


ARROW = pa.schema([("_group", pa.string()), ("_m", pa.list_(pa.float64())), ("_p", pa.list_(pa.float64()))])
PRODUCTS = [(i, j) for i in range(D) for j in range(i, D)]
SUMS = ["n", *[f"s{j}" for j in range(D)], *[f"q{i}_{j}" for i, j in PRODUCTS]]


def _inverted(totals: DataFrame, ridge: float) -> DataFrame:
    """``_group, _start, _m, _p, _logdet`` from sums of the rows of each start."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"_m": [], "_p": [], "_logdet": []}
            for r in b.to_pylist():
                m, cov = np.array([r[f"s{j}"] for j in range(D)]) / r["n"], np.empty((D, D))
                for i, j in PRODUCTS:
                    cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - m[i] * m[j]
                cov += ridge**2 * np.eye(D)
                out["_m"].append(m.tolist()), out["_p"].append(np.linalg.inv(cov).ravel().tolist()), out["_logdet"].append(float(np.linalg.slogdet(cov)[1]))
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("_group"), b.column("_start"), pa.array(out["_m"], numbers), pa.array(out["_p"], numbers), pa.array(out["_logdet"], pa.float64())], names=["_group", "_start", *out])

    summed = totals.groupBy("_group", "_start").agg(*[F.sum(c).alias(c) for c in SUMS])
    return checkpoint(summed.mapInArrow(invert, "_group string, _start int, _m array<double>, _p array<double>, _logdet double"))


def _concentrated(v: DataFrame, params: DataFrame, starts: int, support: float, ridge: float, most: int) -> DataFrame:
    """One concentration step of every group and start."""
    each = params.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_start", "_m", "_p"))).alias("_e"))  # ``starts`` entries
    flat = checkpoint(each.select("_group", F.flatten("_e._m").alias("_m"), F.flatten("_e._p").alias("_p")))
    ds = [f"_d{k}" for k in range(starts)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in XS])
                c = x[:, None] - np.asarray(b.column("_m").flatten()).reshape(-1, starts, D)
                p = np.asarray(b.column("_p").flatten()).reshape(-1, starts, D, D)
                d = ((c[:, :, None, :] @ p)[:, :, 0] * c).sum(2)
                yield pa.RecordBatch.from_arrays([b.column("_group"), *[b.column(k) for k in XS], *[pa.array(np.ascontiguousarray(d[:, k])) for k in range(starts)]], names=["_group", *XS, *ds])

    joined = v.select("_group", *XS).join(_hint(flat, most), "_group").select("_group", *XS, "_m", "_p")
    measured = joined.mapInArrow(measure, "_group string, " + ", ".join(f"{c} double" for c in [*XS, *ds]))
    limits = checkpoint(measured.groupBy("_group").agg(*[F.percentile_approx(d, support, 10_000).alias(f"_l{d}") for d in ds]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}  # groups are few: languages by sources
        for b in batches:
            if not len(b):
                continue
            coded = b.column("_group").dictionary_encode()
            code, n = np.asarray(coded.indices), len(coded.dictionary)
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in XS])
            terms = np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i, j in PRODUCTS]])
            for k, d in enumerate(ds):
                near = b.column(d).to_numpy(zero_copy_only=False) <= b.column(f"_l{d}").to_numpy(zero_copy_only=False)
                sums = np.stack([np.bincount(code[near], terms[near, t], n) for t in range(terms.shape[1])], 1)
                for g, name in enumerate(coded.dictionary.to_pylist()):
                    total.setdefault(name, np.zeros((starts, terms.shape[1])))[k] += sums[g]
        names = list(total)
        values = np.concatenate([total[g] for g in names]) if names else np.empty((0, len(SUMS)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), starts), pa.string()), pa.array(list(range(starts)) * len(names), pa.int32()), *[pa.array(np.ascontiguousarray(values[:, t]), pa.float64()) for t in range(len(SUMS))]], names=["_group", "_start", *SUMS])

    totals = measured.join(_hint(limits, most), "_group").mapInArrow(add, "_group string, _start int, " + ", ".join(f"{c} double" for c in SUMS))
    return _inverted(totals.where("n > 0"), ridge)


def mcd(v: DataFrame, starts: int, steps: int, support: float, ridge: float, most: int) -> DataFrame:
    """``_group, _m, _p, _logdet``: mean, inverse covariance and its log-determinant
    on the best found share ``support`` of each group."""
    near = F.percentile_approx
    middle = v.groupBy("_group").agg(F.count("*").alias("_size"), *[near(x, 0.5, 10_000).alias(f"m{j}") for j, x in enumerate(XS)])
    middle = checkpoint(middle)
    with_middle = v.join(_hint(middle, most), "_group")
    spread = with_middle.groupBy("_group").agg(*[F.first(f"m{j}").alias(f"m{j}") for j in range(D)], *[near(F.abs(F.col(x) - F.col(f"m{j}")), 0.5, 10_000).alias(f"a{j}") for j, x in enumerate(XS)])
    diagonal = [F.lit(0.0) if i != j else 1 / (F.pow(1.4826 * F.col(f"a{i}"), 2) + ridge**2) for i in range(D) for j in range(D)]
    first = checkpoint(spread.select("_group", F.array(*[f"m{j}" for j in range(D)]).alias("_m"), F.array(*diagonal).alias("_p")))
    chance = F.pmod(F.xxhash64("_id", "_start"), F.lit(1 << 40)) < F.lit(1 << 40) * F.lit(8.0 * D) / F.col("_size")  # about 8 * D documents a subset
    few = with_middle.withColumn("_start", F.explode(F.array(*[F.lit(k) for k in range(1, starts)]))).where(chance) if starts > 1 else with_middle.withColumn("_start", F.lit(1)).limit(0)
    sums = [F.lit(1.0).alias("n"), *[F.col(x).alias(f"s{j}") for j, x in enumerate(XS)], *[(F.col(XS[i]) * F.col(XS[j])).alias(f"q{i}_{j}") for i, j in PRODUCTS]]
    drawn = _inverted(few.select("_group", "_start", *sums), ridge).select("_group", "_start", F.col("_m").alias("_dm"), F.col("_p").alias("_dp"))
    every = first.withColumn("_start", F.explode(F.array(*[F.lit(k) for k in range(starts)]))).join(drawn, ["_group", "_start"], "left")
    params = checkpoint(every.select("_group", "_start", F.coalesce("_dm", "_m").alias("_m"), F.coalesce("_dp", "_p").alias("_p")))
    for _ in range(steps):
        params = _concentrated(v, params, starts, support, ridge, most)
    best = params.groupBy("_group").agg(F.min_by(F.struct("_m", "_p", "_logdet"), F.struct("_logdet", "_start")).alias("_b"))
    return checkpoint(best.select("_group", "_b._m", "_b._p", "_b._logdet"))


def outliers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    support: float = 0.75,
    starts: int = 4,
    steps: int = 4,
    cutoff: float = 0.999,
    inflation: float = 2.5,
    ridge: float = 1.0,
    min_group: int = 100,
    max_broadcast: int = 20_000,
) -> DataFrame:
    """``id, lang, source, distance, keep`` of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    every = checkpoint(with_groups(vectors(docs, id_col, text_col, lang_col, source_col), min_group))
    v = every.where("_group is not null")
    near = F.percentile_approx
    params = mcd(v, starts, steps, support, ridge, max_broadcast).drop("_logdet")
    scale = checkpoint(_distances(v, params, max_broadcast, kind).groupBy("_group").agg(near("_d", 0.5, 10_000).alias("_median")))
    half, most = chi2_quantile(0.5, D), chi2_quantile(0.975, D)
    d = _distances(v, params, max_broadcast, kind).join(_hint(scale, max_broadcast), "_group")
    params = _estimate(d.where(F.col("_d") * half <= most * F.greatest("_median", F.lit(1e-12))), ridge)
    final = _distances(v, params, max_broadcast, kind)
    scale = checkpoint(final.groupBy("_group").agg(near("_d", 0.5, 10_000).alias("_median")))
    scaled = final.join(_hint(scale, max_broadcast), "_group").withColumn("_d", F.col("_d") * half / F.greatest("_median", F.lit(1e-12)))
    judged = scaled.select("_id", "_lang", "_source", F.col("_d").alias("distance"), (F.col("_d") <= inflation * chi2_quantile(cutoff, D)).alias("keep"))
    unjudged = every.where("_group is null").select("_id", "_lang", "_source", F.lit(None).cast("double").alias("distance"), F.lit(True).alias("keep"))
    return judged.unionByName(unjudged).select(F.col("_id").alias(id_col), F.col("_lang").alias(lang_col), F.col("_source").alias(source_col), "distance", "keep")
