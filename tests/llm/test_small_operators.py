"""Sharding, mixing, packing, URL filters."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.llm import mixing, packing, sharding, url_filter
from tests.llm.conftest import clash


def naive_table(weights, m):
    import xxhash

    names = sorted(weights)
    perms = {s: [(xxhash.xxh3_64_intdigest(s, seed=1) % m + j * (xxhash.xxh3_64_intdigest(s, seed=2) % (m - 1) + 1)) % m for j in range(m)] for s in names}
    table = [None] * m
    while None in table:
        for s in names:
            for _ in range(weights[s]):
                free = [p for p in perms[s] if table[p] is None]
                if free:
                    table[free[0]] = s
    return [names.index(t) for t in table]


def test_lookup_table_is_the_naive_one():
    w = {"a": 1, "b": 2, "c": 1, "d": 0}
    assert sharding.lookup_table(w, 101).tolist() == naive_table(w, 101)


def test_lookup_table_is_balanced_and_stable():
    names = [f"s{k}" for k in range(20)]
    a, b = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    label = np.array(sorted(names)), np.array(sorted(names[:-1]))
    before, after = label[0][a], label[1][b]
    assert (before != after)[before != "s19"].mean() < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)
    with pytest.raises(ValueError):
        sharding.lookup_table([], 101)


def test_place(spark, odd, empty):
    out = sharding.place(odd, ["x", "y", "z"], table_size=101).collect()
    assert len(out) == 9 and all(r["shard"] in "xyz" for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    assert sharding.place(empty, ["x"], table_size=101).count() == 0
    c = sharding.place(clash(odd), ["x", "y"], table_size=101)
    assert c.columns[-2:] == ["_slot", "_shard"] and c.count() == 9


def brute_mix(rows, weights, budget, seed=7):
    import hashlib

    key = lambda i: hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    per = {}
    for i, s, n in rows:
        per.setdefault(s, []).append((key(i), -1 if i is None else i, n))
    out = []
    for s, items in per.items():
        w = weights.get(s, 1.0)
        for k, i, n in items:
            if w > 0:
                out.append((sum(m for kk, ii, m in items if (kk, ii) <= (k, i)) / w, i, s, n))
    ends = sorted({v for v, *_ in out if sum(n for u, _, _, n in out if u <= v) > budget})
    return sorted(x for x in out if not ends or x[0] < ends[0])


@pytest.mark.parametrize("budget", [0, 5, 40, 200, 10_000])
def test_mix_is_the_brute_force_one(spark, budget):
    rng = np.random.default_rng(budget)
    rows = [(k, f"s{rng.integers(3)}", int(rng.integers(0, 9))) for k in range(80)] + [(3, "s0", 4), (3, "s0", 4)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id bigint, source string, text string")
    weights = {"s0": 3.0, "s1": 0.5}
    got = sorted((r["virtual_finish"], r["doc_id"], r["source"], r["n_tokens"]) for r in mixing.mix(docs, weights, budget).collect())
    assert got == brute_mix(rows, weights, budget)
    kept = mixing.mixed_documents(docs, weights, budget)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for _, i, _, _ in got)


def test_mix_odd_rows(odd, empty):
    assert mixing.mix(odd, {}, share=1.0).count() == 9
    assert mixing.mixed_documents(odd, {"a": 0.0}, share=1.0).where("source = 'a'").count() == 0
    assert mixing.mix(empty, {}, budget=5).count() == 0
    assert mixing.mixed_documents(empty, {}, share=0.5).count() == 0
    assert mixing.mixed_documents(clash(odd), {}, share=1.0).count() == 9
    with pytest.raises(ValueError):
        mixing.mix(odd, {})


def naive_best_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            best = min(r for r, _ in fits)
            k = [k for r, k in fits if r == best]
            out.append((k, best))
            k = out[-1][0]
        else:
            rooms.append(capacity)
            k = [len(rooms) - 1]
            out.append((k, capacity))
        choice = k[0]
        out[-1] = (choice, capacity - rooms[choice])
        rooms[choice] -= n
    return out, rooms


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_fills_the_tightest_bin(lengths):
    lengths = sorted(lengths, reverse=True)
    got = packing.best_fit(lengths, 64)
    rooms = {}
    for (b, offset), n in zip(got, lengths, strict=True):
        fits = [r for r in rooms.values() if r >= n]
        if fits:
            assert rooms[b] == min(fits)
        else:
            assert b == len(rooms)
        assert offset == 64 - rooms.get(b, 64)
        rooms[b] = rooms.get(b, 64) - n
    assert sorted(rooms.values()) == sorted(naive_best_fit(lengths, 64)[1])


def test_pack_keeps_every_token(spark, odd, empty):
    out = packing.pack(clash(odd), capacity=100, group_size=3)
    total = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert {r["doc_id"]: r["n"] for r in total.collect()} == {1: 12, None: 5, 5: 30_000, 6: 6, 7: 1}
    bins = out.groupBy("group_id", "bin_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("bin_offset") + F.col("n_tokens")).alias("end"))
    assert bins.where("n > 100 or end <> n").count() == 0
    assert packing.pack(empty).count() == 0
    many = odd.where("doc_id is null or doc_id = 7").crossJoin(odd.sparkSession.range(500).select(F.col("id").alias("n"))).withColumn("text", F.when(F.col("n") % 9 == 0, F.lit("a b")).otherwise(F.col("text")))
    dealt = packing.pack(many, capacity=10, group_size=50)
    assert dealt.count() == 1000 and dealt.select("doc_id", "copy").distinct().count() == 1000 and dealt.groupBy("group_id").count().agg(F.max("count")).first()[0] <= 300
    assert sorted(r["copy"] for r in out.where("doc_id = 1").collect()) == [0, 1]


URLS = [
    (1, "http://www.example.com/ads/x"), (2, "https://example.com"), (3, "https://EXAMPLE.com.:443/ads#top"), (4, "http://badexample.com/"), (5, "ftp://user@sub.example.com:21/a?b=1"), (6, None), (7, ""),
    (8, "nonsense"), (9, "http://www.example.com/ads/x"), (10, "http://"), (11, "//cdn.example.org/lib"),
]
RULES = [("example.com", "allow"), ("www.example.com", "review"), ("www.example.com/ads", "block"), ("www.example.com/ads", "zap"), ("org", "review"), (None, "block"), ("", "block"), ("*.example.com/a", "block")]
RULES += [("http://shop.example.net:443/ads", "block"), ("example.net:8080", "review"), ("example.net?x=1", "zap"), ("user@example.net/in", "block"), ("http://example.edu", "review"), ("https://*.example.edu:99/b?q", "zap"), ("big.org/\U0010ffff", "block"), ("/only", "block"), ("\U0010ffff", "review")]
URLS += [(12, "https://shop.example.net/ads/1"), (13, "http://example.net:8080/x"), (14, "http://example.net:80801/x"), (15, "http://example.net/?x=1&y"), (16, "http://example.net/?y"), (17, "http://example.net/in/1"), (18, "http://a.example.edu:99/b?q=2")]
URLS += [(19, "http://big.org/\U0010ffff\U0010ffff"), (20, "http://example.com/" + "long/" * 20_000), (21, "http://www.example.com/adsense")]


def brute_rule(key, rules):
    hits = [(len(k), [-ord(c) for c in a], r, a) for k, r, a in rules if key is not None and k and key.startswith(k)]
    return max(hits, key=lambda h: h[:2])[2:] if hits else (None, "allow")


def test_url_filter_against_brute_force(spark):
    urls = spark.createDataFrame(URLS, "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "rule string, action string")
    keys = [(r["k"], r["rule"], r["action"]) for r in rules.withColumn("k", url_filter.rule_key(F.col("rule"))).collect()]
    out = url_filter.apply(urls, rules).collect()
    assert len(out) == len(URLS)
    for r in out:
        assert (r["rule"], r["action"]) == brute_rule(r["url_key"], keys), r
    by = {r["page_id"]: r for r in out}
    assert by[1]["action"] == "block" and by[4]["rule"] is None and by[6]["action"] == "allow" and by[3]["url_key"] == "com.example./ads" and by[11]["rule"] == "org"
    assert [by[k]["action"] for k in range(12, 22)] == ["block", "review", "allow", "zap", "allow", "block", "review", "block", "allow", "block"] and by[14]["rule"] is None
    assert url_filter.after("a\U0010ffff") == "b" and url_filter.after("\U0010ffff") is None and url_filter.after("\ud7ff") == "\ue000"


def test_url_filter_odd_tables(spark):
    urls = spark.createDataFrame(URLS, "page_id bigint, url string")
    none = spark.createDataFrame([], "rule string, action string")
    assert url_filter.apply(urls, none).where("action <> 'allow'").count() == 0
    assert url_filter.apply(urls.limit(0), none).count() == 0
    rules = spark.createDataFrame(RULES, "rule string, action string")
    out = url_filter.apply(clash(urls), rules.select("*", *[F.lit(0).alias(c) for c in ("_k", "_r", "_a", "url", "page_id")]))
    assert out.columns[-3:] == ["_url_key", "_rule", "_action"] and out.count() == len(URLS)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab.", min_size=1, max_size=5), max_size=30), st.sets(st.text("ab.", min_size=1, max_size=4), max_size=12))
def test_sweep_finds_the_longest_prefix(keys, rules):
    keys, rules = sorted(keys), sorted(rules)
    got = url_filter.sweep(keys, [(r, r, "") for r in rules])
    for key, hit in zip(keys, got, strict=True):
        fits = [r for r in rules if key.startswith(r)]
        assert (rules[hit] if hit >= 0 else None) == (max(fits, key=len) if fits else None)
