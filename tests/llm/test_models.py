"""Toxicity, media, quality, HMM."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import hmm, media, quality, toxicity
from tests.llm.conftest import clash


def distance(a, b):
    """Edits with transpositions of neighbours, no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=7), st.sets(st.text("abc", min_size=1, max_size=6), max_size=6), st.integers(0, 2))
def test_automaton_is_levenshtein(word, terms, edits):
    m = toxicity.Automaton({t: (1.0, "fuzzy") for t in terms}, edits, fuzzy_length=1)
    weight, exact = m.match(word)
    assert (weight > 0) == any(distance(word, t) <= edits for t in terms)
    assert exact or word not in terms
    assert m.match(word) == (weight, exact)  # from the determinised states


def test_automaton_kinds():
    m = toxicity.Automaton({"scum": (1.0, "fuzzy"), "stupid": (1.0, "fuzzy"), "loser": (1.0, "fuzzy"), "lower": (0.0, "clean"), "vequ": (0.6, "stem"), "ido": (0.5, "word")})
    assert m.match("scum") == (1.0, True) and m.match("scam")[0] == 0  # too short to be fuzzy
    assert m.match("stuped") == (1.0, False) and m.match("vequaire") == (0.6, True) and m.match("idol")[0] == 0
    assert m.match("lsoer") == (1.0, False) and m.match("lower")[0] == 0


def scores(texts, lexicon=None, **kw):
    p = {"fuzzy_weight": 0.4, "quoted_factor": 0.2, "direct_factor": 1.25, "window": 6} | kw
    terms = toxicity._terms_of(lexicon or [(None, t, 1.0, "fuzzy") for t in toxicity.BASE_TERMS], None)
    machine = toxicity.Automaton(terms)
    return toxicity.score_texts(pa.array(texts, pa.string()), pa.nulls(len(texts), pa.string()), {None: machine}, p)[0].tolist()


def test_context():
    got = scores(['you are an idiot', 'what an idiot', 'he wrote "idiot" there', "they called it stupid", "an idoit passes", "fine words", None, "", 'such "fine things" from an idiot here'])
    assert got == pytest.approx([1.25, 1.0, 0.2, 0.2, 0.4, 0.0, 0.0, 0.0, 1.0])
    assert scores(["an idiott and idiott passes", "an idiott and a morron", "idoit " * 5]) == pytest.approx([0.8, 0.8, 2.0])
    assert scores(['a 12" screen , you are an idiot , is 15" wide', "the term is fine . you idiot", "idiot,moron l'idiot trash/scum", "so »idiot« and „moron“"]) == pytest.approx([1.25, 1.25, 5.0, 0.4])


def brute_score(text, terms, window=6):
    """Distances to every term and marks by looking at each position anew."""
    import re

    words = re.findall(r'[a-z0-9]+|["“”.!?\n]', text.lower())
    total = 0.0
    for k, w in enumerate(words):
        best = 1.0 if w in terms else 0.4 if any(len(t) >= 5 and distance(w, t) <= 1 for t in terms) else 0.0
        if not best or w in '"“”.!?\n':
            continue
        start = max((j + 1 for j in range(k) if words[j] == "\n"), default=0)
        end = min((j for j in range(k, len(words)) if words[j] == "\n"), default=len(words))
        straight = [j for j in range(start, end) if words[j] == '"' and not (j and words[j - 1][-1].isdigit() and sum(words[i] == '"' for i in range(start, j)) % 2 == 0)]
        opens = straight[::2] + [j for j in range(start, end) if words[j] == "“"]
        marks = [j for j in range(start, end) if words[j] in '"“”']
        before, behind = [j for j in marks if k - window <= j < k], [j for j in marks if k < j <= k + window]
        quoted = bool(before and behind and before[-1] in opens and ((words[before[-1]] == '"') == (words[behind[0]] == '"')))
        near = words[max(0, k - window) : k + window + 1]
        left = [j for j in range(k) if words[j] in ".!?\n"]
        right = [j for j in range(k, len(words)) if words[j] in ".!?\n"]
        same = words[max(0, k - window, *[j + 1 for j in left[-1:]]) : min(len(words), k + window + 1, *right[:1])]
        factor = 0.2 if quoted or toxicity.REPORTING & set(same) else 1.25 if toxicity.DIRECT & set(near) else 1.0
        total += best * factor
    return total


def test_scores_against_brute_force():
    rng = np.random.default_rng(7)
    stock = ["idiot", "idoit", "morn", "moron", "scum", "scums", "stupid", "fine", "you", "called", "word", "it", "is", "so", '"', '"', "“", "”", ".", "\n", "12"]
    texts = [" ".join(rng.choice(stock, rng.integers(0, 30))) for _ in range(400)]
    texts = [t for t in texts if ('12 "' not in t)]
    assert scores(texts) == pytest.approx([brute_score(t, toxicity.BASE_TERMS) for t in texts])


def test_a_text_costs_its_own_words_alone():
    from time import process_time

    def seconds(texts):
        began = process_time()
        found = scores(texts)
        return process_time() - began, found

    many = " ".join(f"word{k}" for k in range(200_000))
    alone, _ = seconds([many])
    both, found = seconds([many] + ["an idiot here"] * 2_000)
    assert found[1:] == [1.0] * 2_000 and both < 3 * alone + 1


def test_toxic_rows(spark, odd, empty):
    bad = spark.createDataFrame([(8, "you moron , you idiot", "en", "a", 1), (None, "trash and scum", None, None, 2)], odd.schema)
    docs = clash(odd.union(bad))
    assert {r["doc_id"] for r in toxicity.score(docs).collect()} == {8, None}
    clean = toxicity.score(docs, keep="clean")
    assert clean.columns == docs.columns and clean.count() == 9
    assert toxicity.score(docs, keep="scores").count() == 11 and toxicity.score(empty).count() == 0


def test_learned_terms(spark, empty):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for k in range(200):
        toxic = k % 4 == 0
        words = [f"mot{rng.integers(60)}" for _ in range(20)] + ([f"zorg{rng.integers(30)}", "blarf"] if toxic else [])
        docs.append((k, " ".join(words), "fr")), labels.append((k, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    found = toxicity.learn_lexicon(d, y)
    assert ("fr", "zorg", 0.6, "stem") in found and ("fr", "blarf", 0.6, "fuzzy") in found and not any(t.startswith("mot") for _, t, _, _ in found)
    assert toxicity.learn_lexicon(empty, y) == []
    odd = spark.createDataFrame([(None, None, None), (1, None, "fr"), (2, "", None), (3, "blarf", None)], "doc_id bigint, text string, lang string")
    assert sorted(toxicity.learn_lexicon(d.unionByName(odd), clash_labels(y))) == sorted(found)


def clash_labels(y):
    from pyspark.sql import functions as F

    return y.select("*", *[F.lit(1).alias(c) for c in ("text", "lang", "_id", "_y", "w", "_n")])


def images(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(12, 64))
    rows = [(k, media.pgm(media.draw(v))) for k, v in enumerate(vectors)]
    rows += [(100 + k, media.pgm(media.edited(media.draw(vectors[k]), k % 4))) for k in range(8)]
    rows += [(200, None), (201, b""), (202, b"no image"), (203, media.pgm(np.full((60, 60), 9.0))), (None, rows[0][1]), (3, rows[3][1]), (204, b"P5 9 9 255\n")]
    return spark.createDataFrame(rows, "image_id bigint, image binary")


def test_copies_are_found(spark):
    out = media.find_copies(images(spark)).collect()
    assert {(r["image_a"], r["image_b"]) for r in out} == {(k, 100 + k) for k in range(8)}
    by = {r["image_a"]: r for r in out}
    assert by[0]["scale"] == pytest.approx(1, abs=0.05) and (by[0]["dy"], by[0]["dx"]) == pytest.approx((-10, -6), abs=1.5)
    assert by[3]["scale"] == pytest.approx(0.7, abs=0.05) and abs(by[2]["turn"]) == pytest.approx(np.pi / 2, abs=0.1)
    hot = media.find_copies(images(spark), hot_word=2).collect()  # every shared word is common
    assert {(r["image_a"], r["image_b"]) for r in hot} <= {(k, 100 + k) for k in range(8)}
    assert media.find_copies(images(spark).limit(0)).count() == 0


def test_hamming_tables_keep_recall_at_the_distance():
    rng = np.random.default_rng(8)
    chosen = media.table_bits(media.tables_needed(12, 16, 0.9), 12)
    flips = np.zeros((20_000, 128), bool)
    np.put_along_axis(flips, rng.random(flips.shape).argsort(1)[:, :16], True, 1)
    assert (~flips[:, chosen].any(2)).any(1).mean() >= 0.9


def test_noisy_copies_against_brute_force(spark):
    rng = np.random.default_rng(9)
    first = [media.draw(v) for v in rng.normal(size=(10, 64))]
    pictures = first + [x + rng.normal(0, 20, x.shape) for x in first]
    rows = [(k, media.pgm(x)) for k, x in enumerate(pictures)]
    parts = [media.descriptors(media.decode(b)) for _, b in rows]
    brute = set()
    for a in range(20):
        for b in range(a + 1, 20):
            (pa_, x), (pb, y) = parts[a], parts[b]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None]).sum(2) <= 16)
            if len(i) >= 6 and media.consensus(np.hstack([pa_[i], pb[j]]), 4.0)[0] >= 6:
                brute.add((a, b))
    assert {(k, 10 + k) for k in range(10)} <= brute
    found = {(r["image_a"], r["image_b"]) for r in media.find_copies(spark.createDataFrame(rows, "image_id bigint, image binary")).collect()}
    assert found <= brute and len(found) >= 0.9 * len(brute)


def test_group_of_many_copies(spark):
    rng = np.random.default_rng(4)
    picture = media.draw(rng.normal(size=64), 64)
    rows = [(k, media.pgm(picture + rng.normal(0, 2, picture.shape))) for k in range(270)]
    out = media.find_copies(spark.createDataFrame(rows, "image_id bigint, image binary"))
    found = {(r["image_a"], r["image_b"]) for r in out.collect()}
    assert len(found) >= 0.95 * 270 * 269 / 2
    few = spark.createDataFrame(rows[:40], "image_id bigint, image binary")
    assert sorted(media.find_copies(few, hot_word=2).collect()) == sorted(media.find_copies(few).collect())


def test_matches_of_images_never_leave_their_task(spark):
    out = media.find_copies(images(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "CartesianProduct" in plan


def test_blocks_with_many_matches_are_compared_whole(monkeypatch):
    rng = np.random.default_rng(2)
    picture = media.draw(rng.normal(size=64), 64)
    corners = []
    for _ in range(12):
        p, b = media.descriptors(picture + rng.normal(0, 2, picture.shape))
        c = np.empty(len(p), media.CORNER)
        c["place"], (c["h"], c["l"]) = media.pack_places(p), np.ascontiguousarray(b).view("<u8").T
        corners.append(c)
    ends, both = np.cumsum([len(c) for c in corners]), np.concatenate(corners)
    chosen = media.table_bits(media.tables_needed(12, 16, 0.9), 12)
    masks = np.zeros((len(chosen), 128), np.uint8)
    np.put_along_axis(masks, chosen, 1, 1)
    args = (both, both, ends, ends, True, chosen, np.packbits(masks, axis=1).view("<u8"), 16, 6, 4.0)
    whole = list(media.block_copies(*args))
    assert {(a, b) for a, b, *_ in whole} == {(a, b) for b in range(12) for a in range(b)}
    monkeypatch.setattr(media, "MATCHES", 40)
    assert sorted(media.block_copies(*args)) == sorted(whole)


def corners_of(image):
    p, b = media.descriptors(media.decode(media.pgm(image)))
    c = np.empty(len(p), media.CORNER)
    c["place"], (c["h"], c["l"]) = media.pack_places(p), np.ascontiguousarray(b).view("<u8").T
    return c


def test_unrelated_images_cost_few_comparisons(monkeypatch):
    rng = np.random.default_rng(12)
    corners = [corners_of(media.draw(v)) for v in rng.normal(size=(120, 64))]
    a, b = np.concatenate(corners[:60]), np.concatenate(corners[60:])
    ends_a, ends_b = np.cumsum([len(c) for c in corners[:60]]), np.cumsum([len(c) for c in corners[60:]])
    key_bits = media.find_copies.__defaults__[-2]
    tables = media.pair_tables(key_bits, 16, 6, 0.9) if hasattr(media, "pair_tables") else media.tables_needed(key_bits, 16, 0.9)
    chosen = media.table_bits(tables, key_bits)
    masks = np.zeros((len(chosen), 128), np.uint8)
    np.put_along_axis(masks, chosen, 1, 1)
    count, done = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x: (done.append(x.size), count(x))[1])
    assert not list(media.block_copies(a, b, ends_a, ends_b, False, chosen, np.packbits(masks, axis=1).view("<u8"), 16, 6, 4.0))
    assert sum(done) / 2 < 60 * 60 * 60  # about 750 a pair of images by tables of 12 bits, 12,000 by brute force


def test_two_of_six_matches_are_found():
    rng = np.random.default_rng(8)
    chosen = media.table_bits(media.pair_tables(32, 16, 6, 0.9), 32)
    flips = np.zeros((12_000, 128), bool)
    np.put_along_axis(flips, rng.random(flips.shape).argsort(1)[:, :12], True, 1)
    found = np.logical_or.reduce([~flips[:, bits].any(1) for bits in chosen])
    assert (found.reshape(-1, 6).sum(1) >= 2).mean() >= 0.88  # 0.9 but for the sample and tables that share bits


def test_resized_noisy_copies_against_brute_force(spark):
    rng = np.random.default_rng(21)
    first = [media.draw(v) for v in rng.normal(size=(45, 64))]
    pictures = first + [media._resize(x, 77, 77) + (k % 2) * rng.normal(0, 8, (77, 77)) for k, x in enumerate(first[:36])] + [media._resize(x, 58, 58) for x in first[36:]]
    parts, brute = [corners_of(x) for x in pictures], set()
    for a in range(90):
        for b in range(a + 1, 90):
            x, y = parts[a], parts[b]
            i, j = np.nonzero(np.bitwise_count(x["h"][:, None] ^ y["h"]) + np.bitwise_count(x["l"][:, None] ^ y["l"]) <= 16)
            if len(i) >= 6 and media.consensus(np.hstack([media.unpack_places(x["place"][i]), media.unpack_places(y["place"][j])]), 4.0)[0] >= 6:
                brute.add((a, b))
    rows = [(k, media.pgm(x)) for k, x in enumerate(pictures)]
    found = {(r["image_a"], r["image_b"]) for r in media.find_copies(spark.createDataFrame(rows, "image_id bigint, image binary")).collect()}
    assert len(brute) >= 35 and found <= brute and len(found) >= 0.9 * len(brute)


def test_png_round_trip():
    import zlib

    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (9, 7), dtype=np.uint8)
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + b"0000"
    lines, prev = [], np.zeros(7, np.int64)
    for y, row in enumerate(x.astype(np.int64)):
        left = np.concatenate([[0], row[:-1]])
        kind = y % 4
        body = [row, row - left, row - prev, row - (left + prev) // 2][kind] & 255
        lines.append(bytes([kind]) + body.astype(np.uint8).tobytes())
        prev = row
    head = (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (media.decode(data) == x).all() and (media.decode(media.pgm(x)) == x).all()
    assert media.decode(data[:40]) is None


def test_statistics():
    x = quality.statistics(pa.array(["Ab, 1\nc c", None, ""])) * np.array(list(quality.FEATURES.values()))
    assert x.shape == (3, 7) and np.isfinite(x).all() and x[0, 0] == pytest.approx(np.log(5)) and (x[1] == x[2]).all()


def test_outliers(spark, odd, empty):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    rows = []
    for k in range(400):
        text = " ".join(word() for _ in range(rng.integers(60, 200))).capitalize() + "."
        if k % 40 == 7:
            text = "$$$ ### !!! " * 60
        rows.append((k, text, "en", f"s{k % 2}", len(text)))
    docs = spark.createDataFrame(rows, odd.schema)
    out = {r["doc_id"]: r["keep"] for r in quality.outliers(docs).collect()}
    bad = {k for k in range(400) if k % 40 == 7}
    assert len(out) == 400 and {k for k, keep in out.items() if not keep} >= bad
    assert sum(not keep for keep in out.values()) <= len(bad) + 8
    small = quality.outliers(clash(odd))
    assert small.count() == 9 and small.where("not keep or distance is not null").count() == 0
    assert quality.outliers(odd, min_group=2).count() == 9 and quality.outliers(empty).count() == 0


def test_chi_square_quantiles():
    assert quality.chi2_quantile(0.5, 7) == pytest.approx(6.346, rel=0.01) and quality.chi2_quantile(0.999, 7) == pytest.approx(24.32, rel=0.01)


def brute_mcd(x, support, ridge, rng):
    """Least log-determinant over many random starts, each concentrated to the end."""
    h, best = int(np.ceil(support * len(x))), (np.inf, None)
    for _ in range(60):
        some = x[rng.choice(len(x), 16, False)]
        for _ in range(15):
            m, c = some.mean(0), np.cov(some.T, bias=True) + ridge**2 * np.eye(x.shape[1])
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
            some = x[np.argsort(d)[:h]]
        det = np.linalg.slogdet(np.cov(some.T, bias=True) + ridge**2 * np.eye(x.shape[1]))[1]
        best = min(best, (det, some.mean(0).tolist()))
    return best


def test_mcd_resists_contamination(spark):
    rng = np.random.default_rng(6)
    rows, parts = [], {}
    for g in ("a", "b"):
        mixing = rng.normal(size=(7, 7))
        x = rng.normal(size=(400, 7)) @ mixing
        x[:80] = 25 + 0.3 * rng.normal(size=(80, 7))  # a fifth of the group, in one place
        parts[g] = x
        rows += [(k, g, *map(float, v)) for k, v in enumerate(x)]
    v = spark.createDataFrame(rows, "_id bigint, _group string, " + ", ".join(f"_x{j} double" for j in range(7)))
    found = {r["_group"]: r for r in quality.mcd(v, 4, 6, 0.75, 0.1, 100).collect()}
    for g, x in parts.items():
        det, mean = brute_mcd(x, 0.75, 0.1, rng)
        assert found[g]["_logdet"] <= det + 0.3
        clean = x[80:].mean(0)
        assert np.abs(np.array(found[g]["_m"]) - clean).max() < 1.5 and np.abs(np.array(mean) - clean).max() < 1.5 and np.abs(x.mean(0) - clean).max() > 3


def naive_likelihood(model, symbols):
    alpha = model.start * model.emit[symbols[0]]
    for s in symbols[1:]:
        alpha = (alpha @ model.move) * model.emit[s]
    return np.log(alpha.sum())


def all_paths(model, symbols):
    """Expected counts by enumerating state paths."""
    import itertools

    k = len(model.start)
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
    for path in itertools.product(range(k), repeat=len(symbols)):
        p = model.start[path[0]] * model.emit[symbols[0], path[0]]
        for a, b, s in zip(path, path[1:], symbols[1:], strict=False):
            p *= model.move[a, b] * model.emit[s, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            move[a, b] += p
        for a, s in zip(path, symbols, strict=True):
            emit[s, a] += p
    return start / total, move / total, emit / total


def test_forward_and_counts_are_exact():
    rng = np.random.default_rng(4)
    e = hmm.Estimate(np.full(3, 1 / 3), np.array([[0.5, 0.3, 0.2], [0.1, 0.6, 0.3], [0.3, 0.3, 0.4]]), 40.0, np.ones(3), None)
    model = hmm.Model(e.start, e.move, hmm.emissions(e, np.arange(8, dtype=np.uint64), np.column_stack([rng.integers(1, 9, 8), np.zeros((8, 3))])))
    rows = [rng.integers(0, 8, n) for n in (5, 0, 1, 7, 3)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.concatenate(rows)
    got = hmm.forward(model, flat, offsets)
    assert got == pytest.approx([naive_likelihood(model, r) if len(r) else 0.0 for r in rows])
    start, move, emit, total = hmm.expected(model, flat, offsets, 8)
    parts = [all_paths(model, r) for r in rows if len(r)]
    assert start == pytest.approx(sum(p[0] for p in parts)) and move == pytest.approx(sum(p[1] for p in parts)) and emit == pytest.approx(sum(p[2] for p in parts))
    assert total == pytest.approx(got.sum())
    assert hmm.segments(np.array([0, 5, 5, 6]), 2).tolist() == [0, 2, 4, 5, 6]


def serial(texts, states, rounds, segment, smoothing):
    """The same model by one table in one place, segment by segment: log-likelihoods and trace."""
    codes, offsets = hmm.word_codes(pa.array(texts, pa.string()))
    words, symbols = np.unique(codes, return_inverse=True)
    counts = np.bincount(symbols, minlength=len(words)).astype(float)
    emit = counts[:, None] * hmm.tilt(words, states)
    move = np.random.default_rng(11).uniform(0.5, 1.5, (states, states))
    model, trace = hmm.Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0)), []
    for _ in range(rounds):
        start, move, emit, total = np.zeros(states), np.zeros((states, states)), np.zeros((len(words), states)), 0.0
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            for lo in range(a, b, segment):
                part = symbols[lo : min(lo + segment, b)]
                got = hmm.expected(model, part, np.array([0, len(part)]), len(words))
                start, move, emit, total = start + got[0], move + got[1], emit + got[2], total + got[3]
        trace.append(total)
        emit = emit + smoothing * len(codes) / states * (counts / len(codes))[:, None]
        start, move = start + 1, move + 1
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return [naive_likelihood(model, symbols[a:b]) if b > a else 0.0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)], trace


def switching(seed=2, n=60):
    rng = np.random.default_rng(seed)
    return [" ".join(f"{'ab'[t // 5 % 2]}{rng.integers(9)}" for t in range(k)) for k in rng.integers(0, 90, n)]


def test_distributed_training_equals_serial(spark, odd):
    texts = switching()
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], odd.schema).repartition(3)
    want, likelihoods = serial(texts, 3, 4, 16, 0.01)
    for words in (1, 100, 1 << 21):  # chunks of a document, of a few, of a partition
        chunked = hmm.settled(hmm.chunks(docs, "doc_id", "text", words))
        assert (chunked.count() > 40) == (words == 1)
        assert hmm.train(chunked, 3, 4, 16, 0.01, 0.0)[2] == pytest.approx(likelihoods, rel=1e-5)
    scored = hmm.score(docs, states=3, rounds=4, segment=16, tolerance=0.0)
    assert scored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_c") == 1  # chunks stay in place
    got = {r["doc_id"]: r["log_likelihood"] for r in scored.collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_training_raises_the_likelihood(spark, odd):
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(switching())], odd.schema)
    chunked = hmm.checkpoint(hmm.chunks(docs, "doc_id", "text"))
    estimate, back, trace = hmm.train(chunked, states=3, rounds=6, smoothing=0.0, tolerance=0.0)
    assert all(b > a for a, b in zip(trace, trace[1:], strict=False)) and estimate.move.sum(1) == pytest.approx(1)
    assert len(hmm.train(chunked, states=3, rounds=50, tolerance=0.5)[2]) == 2  # stops where little is gained
    words = np.frombuffer(chunked.first()["_vocab"], "<u8")
    counts = hmm._counts(pa.table({"_d": pa.array([bytes(r["_d"]) for r in back.collect()], pa.binary())}), len(words), 3)
    assert hmm.emissions(estimate, words, counts).sum(0) == pytest.approx(1, abs=1e-5)


def test_messages_of_three_rounds_take_little_room(spark, odd, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 5_000) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], odd.schema)
    chunked, states = hmm.settled(hmm.chunks(docs, "doc_id", "text", 4_000)), 6
    steps, write = [], hmm.Rounds.write

    def counted(self, messages):
        out = write(self, messages)
        steps.append(out.where("_d is not null").selectExpr("sum(length(_d))").first()[0])
        return out

    monkeypatch.setattr(hmm.Rounds, "write", counted)
    hmm.train(chunked, states, 3, tolerance=0.0)
    rows = chunked.selectExpr("sum(_n)").first()[0]
    assert len(steps) == 8 and max(steps) < 36 * rows  # 40 bytes a row up and 32 back uncompressed
    assert max(steps[1::2]) < 26 * rows
    assert chunked.selectExpr("sum(length(_symbols))").first()[0] < 1.9 * sum(len(t.split()) for t in texts)  # 2 bytes a word before


def test_packed_columns_come_back():
    for n in (0, 1, 1000):
        columns = [np.arange(n, dtype="<u8") * 977, np.arange(n, dtype="<u4")[::-1], np.linspace(0, 1, n, dtype="<f4")]
        got = hmm.unpack(pa.py_buffer(hmm.pack(*columns)), "<u8", "<u4", "<f4")
        assert all((x == y).all() and x.dtype == y.dtype and len(x) == n for x, y in zip(columns, got, strict=True))


def test_scores_odd_rows(odd, empty):
    out = {(r["doc_id"], r["n_words"]): r for r in hmm.score(clash(odd), states=2, rounds=1).collect()}
    assert out[(2, 0)]["log_likelihood"] == 0 and out[(2, 0)]["per_word"] is None and out[(3, 0)]["per_word"] is None
    assert out[(1, 6)]["log_likelihood"] == pytest.approx(out[(6, 6)]["log_likelihood"]) and out[(5, 30000)]["log_likelihood"] < -30000
    assert hmm.score(empty, states=2, rounds=1).count() == 0
    assert [r["log_likelihood"] for r in hmm.score(odd.where("doc_id in (2, 3)"), states=2, rounds=1).collect()] == [0.0] * odd.where("doc_id in (2, 3)").count()
