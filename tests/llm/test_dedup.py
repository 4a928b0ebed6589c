"""N-gram join, components and suffix-array dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import components, ngram_join, suffix_dedup
from plinth.llm._text import word_codes
from tests.llm.conftest import LONG, clash


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edit(rng, text, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text]


def jaccard(a, b, n=3):
    grams = lambda t: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} or {tuple(t)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(20, 120)) for _ in range(60)]
    for k in range(25):
        texts += [edit(rng, texts[k], s) for s in (0.0, 0.02, 0.06, 0.12)]
    hot = words(rng, 80)
    texts += [edit(rng, hot, 0.01) for _ in range(150)]
    return {k: t for k, t in enumerate(texts)}


def pairs_of(df):
    """{(a, b): jaccard} of the links, those between copies implied, and their number as rows."""
    rows = df.collect()
    ids = {}
    for r in rows:
        if r["copy"]:
            ids.setdefault(r["doc_a"], {r["doc_a"]}).add(r["doc_b"])
    out = {}
    for r in rows:
        for a in [r["doc_a"]] if r["copy"] else ids.get(r["doc_a"], {r["doc_a"]}):
            for b in ids.get(r["doc_b"], {r["doc_b"]}):
                out[min(a, b), max(a, b)] = r["jaccard"]
    for group in ids.values():
        out |= {(a, b): 1.0 for a in group for b in group if a < b}
    return out, len(rows)


@pytest.mark.parametrize("limit", [2048, 20])
def test_all_pairs_against_brute_force(spark, corpus, limit):
    """Every pair counts, those of the hot groups too, and all similarities are exact."""
    copy = words(random.Random(6), 70)
    docs = corpus | {1000 + k: copy for k in range(100)} | {2000: [], 2001: []}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id bigint, text string")
    df = df.union(df.where("doc_id < 5 or doc_id = 1000"))
    got, n_rows = pairs_of(ngram_join.all_pairs(df, limit=limit))
    want = {(a, b): j for a in corpus for b in corpus if a < b and (j := jaccard(corpus[a], corpus[b])) >= 0.5}
    want |= {(1000 + a, 1000 + b): 1.0 for a in range(100) for b in range(a + 1, 100)}
    assert not set(got) - set(want) and len(got) >= 0.98 * len(want)
    assert all(j == pytest.approx(want[p]) for p, j in got.items())
    assert n_rows <= len(want) - 100 * 99 / 2 + 99  # copies aren't expanded
    rows = ngram_join.links(df, limit=limit).collect()
    degree = dict.fromkeys((v for p in got for v in p), 0)
    for p in got:
        for v in p:
            degree[v] += 1
    assert {r["doc_id"]: r["n_links"] for r in rows} == degree and len(rows) == len(degree)
    assert {r["doc_id"]: r["copy_of"] for r in rows} == {v: 1000 if 1000 <= v < 1100 else min([u for u in docs if docs[u] == docs[v]]) for v in degree}
    kept = {r[0] for r in ngram_join.keep_one(df, limit=limit).select("doc_id").collect()}
    root = {}
    for a, b in sorted(want):  # components by the least id
        x, y = (next(iter([v for v in [root.get(v, v)]])) for v in (a, b))
        for k in [k for k in docs if root.get(k, k) in (x, y)]:
            root[k] = min(x, y)
    least = {k: root.get(k, k) for k in docs}
    assert len(kept ^ {k for k in docs if least[k] == k}) <= 2
    assert sum(r["group_id"] != least[r["doc_id"]] for r in rows) <= 0.01 * len(rows)


def test_links_of_texts_that_share_an_id(spark):
    """Ids 5 and 7 are linked by texts that both have 1 as their least id."""
    x = [f"w{k}" for k in range(40)]
    rows = [(1, x), (5, x), (1, [*x, "end"]), (7, [*x, "end"]), (9, [*x[:5]])]
    got, _ = pairs_of(ngram_join.all_pairs(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")))
    assert set(got) >= {(1, 5), (1, 7)} and all(9 not in p for p in got)


@pytest.mark.parametrize("limit", [32])
def test_recall_near_the_threshold_in_oversized_buckets(spark, limit):
    """Pairs just above the threshold, of words that many dissimilar documents have."""
    rng = random.Random(12)
    texts = []
    for _ in range(1500):
        drawn = rng.sample(range(160), 53)
        texts += [drawn[:40], drawn[13:]]  # 27 of 53 words in common
    df = spark.createDataFrame([(k, " ".join(f"w{w}" for w in t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r[0], r[1]) for r in ngram_join.all_pairs(df, n=1, limit=limit).collect()}
    assert len({(k, k + 1) for k in range(0, 3000, 2)} & got) >= 0.95 * 1500


def test_a_lower_threshold(spark, corpus):
    few = {k: corpus[k] for k in list(corpus)[:120]}
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in few.items()], "doc_id bigint, text string")
    want = {(a, b) for a in few for b in few if a < b and jaccard(few[a], few[b]) >= 0.3}
    got = set(pairs_of(ngram_join.all_pairs(df, threshold=0.3))[0])
    assert not got - want and len(got) >= 0.95 * len(want)
    with pytest.raises(ValueError):
        ngram_join.all_pairs(df, threshold=0)


def test_runs_reach_the_recall():
    for t in (0.3, 0.5, 0.8):
        b = -(-1 // t)
        q = ngram_join.survival(int(b), t, 3)
        assert 1 - (1 - q) ** ngram_join.runs_needed(int(b), t, 3, 0.95) >= 0.95


def test_join_odd_rows(odd, empty):
    got = {(r[0], r[1]) for r in ngram_join.all_pairs(clash(odd)).collect()}
    assert got == {(1, 6)} and sorted(tuple(r) for r in ngram_join.links(clash(odd)).collect()) == [(1, 1, 1, 1), (6, 1, 1, 1)]
    kept = ngram_join.keep_one(clash(odd))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "3", "4", "5", "7", "None"] and kept.columns == clash(odd).columns
    assert ngram_join.all_pairs(empty).count() == ngram_join.links(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(None, 3), (5, 5)] + [(k, k + 1) for k in range(200, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    least = {}
    for x in parent:
        least.setdefault(find(x), []).append(x)
    assert got == {x: min(g) for g in least.values() for x in g if x != min(g)}


def brute_repeats(texts, length):
    """{(text, first): covered words} by looking at every window; texts in order of their names."""
    seen, out = {}, {}
    for i in sorted(texts):
        t = texts[i]
        for p in range(len(t) - length + 1):
            seen.setdefault(tuple(t[p : p + length]), []).append((i, p))
    for places in seen.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(sorted(places)):
                out.setdefault((i, k == 0), set()).update(range(p, p + length))
    return out


def covered(df, name=lambda r: r["doc_id"]):
    out = {}
    for r in df.collect():
        cell = out.setdefault((name(r), r["first"]), set())
        new = set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert not cell & new
        cell |= new
    return out


def by_key(df):
    """Texts of a table by (null id last, id, key), as ``brute_repeats`` takes them."""
    rows = df.select("doc_id", "text", suffix_dedup.text_key("doc_id", "text").alias("k")).where("text is not null").collect()
    return {(r["doc_id"] is None, r["doc_id"] or 0, r["k"]): r["text"].split() for r in rows}


@pytest.mark.parametrize("length", [5, 9, 50])
def test_repeats_of_texts_that_share_ids(spark, length):
    """Few ids, many texts: each text has its own intervals, and only repeats are cut."""
    rng = random.Random(3)
    passage = words(rng, 2 * length, 9)
    rows = [(rng.choice([0, 1, 2, None]), words(rng, rng.randrange(0, length), 9) + passage[rng.randrange(length) :] * (k % 3 > 0) + words(rng, rng.randrange(0, 3 * length), 60)) for k in range(40)]
    rows += [rows[5], rows[6]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    texts = by_key(df)
    want = brute_repeats(texts, length)
    assert covered(suffix_dedup.repeats(df, length), lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_key"])) == want
    left = by_key(suffix_dedup.drop_repeats(df.distinct(), length))
    expected = []
    for name, t in texts.items():
        gone = want.get((name, False), set())
        rest = [w for k, w in enumerate(t) if k not in gone]
        expected += [(name[:2], rest)] if rest or not t else []
    assert sorted((k[:2], t) for k, t in left.items()) == sorted(expected)


def test_a_text_that_occurs_once_stays(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(120)) for c in "ab")
    df = spark.createDataFrame([(0, b), (1, a), (1, b)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in suffix_dedup.drop_repeats(df).collect()) == sorted([(0, b), (1, a)])


def test_names_cover_just_the_words():
    for length in range(4, 501):
        cover, reach = length - 2, suffix_dedup.first_reach(length - 2)
        assert 0 < reach <= 18
        while reach < cover:
            one, two = suffix_dedup.next_shifts(reach, cover)
            assert one % 3 == two % 3 == 0 and 0 < one <= two <= reach + one
            assert one <= reach
            reach += two
        assert reach == cover


@pytest.mark.parametrize("length", [4, 7, 20, 50])
def test_repeats_are_the_brute_force_ones(spark, length):
    rng = random.Random(length)
    vocabulary = 6 if length < 10 else 50
    texts = {k: words(rng, rng.randrange(0, 4 * length), vocabulary) for k in range(20)}
    passage = words(rng, length + 9, vocabulary)
    for k in range(20, 32):
        a, b = words(rng, rng.randrange(0, length), vocabulary), words(rng, rng.randrange(0, length), vocabulary)
        texts[k] = a + passage[: rng.randrange(length - 1, len(passage))] + b
    texts[40], texts[41] = texts[25], ["same"] * (3 * length)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id bigint, text string")
    assert covered(suffix_dedup.repeats(df, length)) == brute_repeats(texts, length)


def test_merged_order_is_the_suffix_order():
    """On one text, with names by brute force."""
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 200)
    suffix = [tuple(text[i:]) for i in range(200)] + [()] * 3
    name = np.zeros(203, np.uint64)
    sampled = [i for i in range(200) if i % 3]
    for k, i in enumerate(sorted(sampled, key=lambda i: suffix[i])):
        name[i] = k + 1
    padded = np.concatenate([text, [0, 0, 0]]).astype(np.uint64)
    s = np.zeros(200, suffix_dedup.SUFFIX)
    at = np.arange(200)
    s["words"] = padded[at] << np.uint64(32) | padded[at + 1]
    s["residue"], s["at"] = at % 3, at
    s["x"] = np.where(at % 3 == 0, name[at + 1], name[at])
    s["y"] = np.where(at % 3 == 1, name[at + 1], name[at + 2])
    assert suffix_dedup.merged_order(s).tolist() == sorted(range(200), key=lambda i: suffix[i])


def test_repeats_odd_rows(spark, odd, empty):
    twice = odd.union(odd.where("doc_id = 5").withColumn("doc_id", F.lit(9).cast("bigint")))
    got = {(r["doc_id"], r["first"]): (r["start_word"], r["n_words"]) for r in suffix_dedup.repeats(clash(twice), 400).collect()}
    n = len(LONG.split())
    assert got == {(5, True): (0, 1376), (5, False): (977, n - 977), (9, False): (0, n)}
    named = clash(odd).withColumnRenamed("doc_id", "text_key")
    assert suffix_dedup.repeats(named, 50, "text_key").columns[:2] == ["text_key", "_text_key"] and suffix_dedup.repeats(odd, 50).count() == 2 and suffix_dedup.repeats(empty).count() == 0
    with pytest.raises(TypeError):
        suffix_dedup.repeats(odd.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_drop_repeats(spark, odd, empty):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"one {p} end", None, None, 0), (2, f"Two,  {p}\nfin  here", "en", "a", 9), (3, p, None, None, 1), (4, "short", None, None, 5), (None, p, None, None, 3)]
    docs = clash(spark.createDataFrame(rows, odd.schema))
    out = {r["doc_id"]: r for r in suffix_dedup.drop_repeats(docs).collect()}
    assert set(out) == {1, 2, 4} and out[1]["text"] == rows[0][1] and out[1]["n_chars"] == 0
    assert out[2]["text"] == "Two,  fin  here" and out[2]["n_chars"] == 15
    assert suffix_dedup.drop_repeats(empty).count() == 0


def test_without():
    assert suffix_dedup.without(" a b\tc  d ", [(1, 2)]) == "a d"
    assert suffix_dedup.without("a b", [(0, 2)]) == "" and suffix_dedup.without(" a ", []) == " a "


def test_tiles_cover_every_window():
    codes, offsets = word_codes(pa.array([" ".join(f"w{k % 13}" for k in range(90)), "", "a b c"]))
    _, _, row, at, span = suffix_dedup.tiles(codes, offsets, 10)
    seen = sorted((r, p) for r, a, s in zip(row, at, span, strict=True) for p in range(a, a + s + 1))
    assert seen == [(0, p) for p in range(81)]
