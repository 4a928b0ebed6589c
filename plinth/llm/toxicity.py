"""Toxicity: a lexicon matched through Levenshtein automata, weighed by context.

The lexicon is a trie.  Each term's Levenshtein automaton is simulated over it:
a state is a set of (trie node, edits) pairs, determinised lazily, so that one
walk over a word's letters intersects the word with the automata of all terms.
Every distinct word of a batch is walked once.

Words are runs of letters and digits, so that terms joined
by a comma, slash, hyphen or apostrophe are words of their own.  A hit weighs its
term's weight when the term is spelled exactly, times ``fuzzy_weight`` when it is
misspelled; every occurrence counts.  A misspelling is an insertion, deletion,
substitution or transposition of neighbours.  Around each hit a window of words
is read: between two quotation marks of which the first opens and the second
closes within the window, or near a word of reporting ("called", "quote", ...) of
the same sentence, the weight is multiplied by ``quoted_factor``; near a word that
addresses someone, by ``direct_factor``.  A document's score is the sum; it is
rejected from ``threshold`` on.

``learn_lexicon`` adds terms and word stems for every language from labelled
documents.  It reads at most ``max_labelled`` rows a language and class (the
lowest by a hash of the id), a documented bound of the fitted part alone;
scoring reads all documents and whole texts.  A learned word is fuzzy, too, unless
clean labelled documents hold words within reach of it, or of more than a share
``max_confused`` of its language's learned words.  Words that they hold are never taken for misspellings of a built-in term: those within reach come as
``"clean"`` terms.

Nulls, ties, odd input: a null or empty text has score 0 and is never rejected, a
very long text is read whole; a null language uses the terms of all languages, a
language without terms those of no language; a null id is scored like any other
row; repeated rows are scored each; of several entries for a term the greatest
weight and the widest kind count; labels of null ids or classes are ignored, of
several labels for an id the largest counts; an empty table gives an empty
result.  Other columns are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm._text import pieces
from plinth.llm._util import checkpoint, map_rows, quoted

BASE_TERMS = ("idiot", "moron", "scum", "worthless", "trash", "loser", "stupid", "pathetic", "disgusting", "clown")
REPORTING = frozenset("said says called calls quote quoted quotes wrote term word words dit appelé mot citation sagte nannte wort zitat dijo llamó palabra cita".split())
DIRECT = frozenset("you your you're youre u du dich dir ihr vous tu toi te usted vosotros".split())
KINDS = ("clean", "word", "fuzzy", "stem")
Term = tuple[str | None, str, float, str]  # language, term, weight, kind
QUOTES = "\"“”«»„"
TOKEN = re.compile(r"[^\W_]+|[" + QUOTES + r".!?\n]")


class Automaton:
    """Union of the Levenshtein automata of a lexicon, run over its trie.

    ``terms`` maps a term to ``(weight, kind)``.  A ``"stem"`` also accepts any
    ending; a ``"fuzzy"`` term of at least ``fuzzy_length`` letters accepts up to
    ``edits`` insertions, deletions, substitutions and transpositions of
    neighbours (no part of a word edited twice); a ``"word"`` only itself; a
    ``"clean"`` term matches nothing, and isn't taken for a misspelling.
    """

    def __init__(self, terms: dict[str, tuple[float, str]], edits: int = 1, fuzzy_length: int = 5):
        self.children: list[dict[str, int]] = [{}]
        self.exact: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.fuzzy: list[float] = [0.0]
        self.reach: list[bool] = [False]  # a fuzzy term lies at or below
        self.edits = edits
        self.clean = {t for t, (_, kind) in terms.items() if kind == "clean"}
        for term, (weight, kind) in sorted(terms.items()):
            if kind == "clean":
                continue
            node, stem, fuzzy = 0, kind == "stem", kind == "fuzzy" and len(term) >= fuzzy_length
            self.reach[0] |= fuzzy
            for letter in term:
                nxt = self.children[node].get(letter)
                if nxt is None:
                    nxt = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.exact.append(0.0), self.stem.append(0.0), self.fuzzy.append(0.0), self.reach.append(False)
                node = nxt
                self.reach[node] |= fuzzy
            self.exact[node] = max(self.exact[node], weight)
            if stem:
                self.stem[node] = max(self.stem[node], weight)
            if fuzzy:
                self.fuzzy[node] = max(self.fuzzy[node], weight)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[float, float, float]] = []
        self.start = self._state({(0, 0, "")})
        self.dead = self._state(set())

    def _state(self, pairs: set[tuple[int, int, str]]) -> int:
        """Number of the state with these (node, edits, letter that must follow); the
        letter is that of a transposition half done, empty otherwise."""
        todo = [(n, e) for n, e, swap in pairs if not swap]
        while todo:  # a letter of the term is missing in the word
            node, e = todo.pop()
            if e < self.edits:
                for child in self.children[node].values():
                    if self.reach[child] and (child, e + 1, "") not in pairs:
                        pairs.add((child, e + 1, ""))
                        todo.append((child, e + 1))
        best: dict[tuple[int, str], int] = {}
        for node, e, swap in pairs:
            best[node, swap] = min(e, best.get((node, swap), e))
        key = frozenset((n, e, swap) for (n, swap), e in best.items())
        if (found := self.states.get(key)) is not None:
            return found
        state = self.states[key] = len(self.members)
        self.members.append(key)
        self.moves.append({})
        at = [(n, e) for n, e, swap in key if not swap]
        exact = max((self.exact[n] for n, e in at if e == 0), default=0.0)
        stem = max((self.stem[n] for n, e in at if e == 0), default=0.0)
        fuzzy = max((self.fuzzy[n] for n, e in at if e > 0), default=0.0)
        self.final.append((exact, stem, fuzzy))
        return state

    def _move(self, state: int, letter: str) -> int:
        pairs: set[tuple[int, int, str]] = set()
        for node, e, swap in self.members[state]:
            if swap:
                if letter == swap:
                    pairs.add((node, e, ""))
                continue
            child = self.children[node].get(letter)
            if child is not None and (e == 0 or self.reach[child]):
                pairs.add((child, e, ""))
            if e < self.edits:
                if self.reach[node]:
                    pairs.add((node, e + 1, ""))  # a letter too many in the word
                for skipped, c in self.children[node].items():
                    if self.reach[c]:
                        pairs.add((c, e + 1, ""))
                        after = self.children[c].get(letter)
                        if after is not None and self.reach[after] and skipped != letter:
                            pairs.add((after, e + 1, skipped))
        nxt = self._state(pairs)
        if len(self.moves[state]) < 4096:
            self.moves[state][letter] = nxt
        return nxt

    def match(self, word: str) -> tuple[float, bool]:
        """(weight, exact) of the best term that the word matches; weight 0 for none."""
        state, stem, moves = self.start, 0.0, self.moves
        for letter in word:
            nxt = moves[state].get(letter)
            if nxt is None:
                nxt = self._move(state, letter)
            state = nxt
            if self.final[state][1] > stem:
                stem = self.final[state][1]
            if state == self.dead:
                return stem, True
        exact, _, fuzzy = self.final[state]
        if max(exact, stem) > 0:
            return max(exact, stem), True
        return (0.0 if fuzzy and word in self.clean else fuzzy), False


def _terms_of(lexicon: Iterable[Term], lang: str | None) -> dict[str, tuple[float, str]]:
    out: dict[str, tuple[float, str]] = {}
    for lg, term, weight, kind in lexicon:
        if term and (lg is None or lang is None or lg == lang):
            old = out.get(term, (0.0, "word"))
            out[term] = (max(old[0], weight), max(old[1], kind, key=KINDS.index))
    return out


def tokens(text: str) -> list[str]:
    """Lower-cased words, quotation marks, sentence ends and line ends of a text, in order."""
    return TOKEN.findall(text.lower())


def opening_marks(words: list[str]) -> set[int]:
    """Places of the marks that open a quotation: the low and left ones, and of the
    straight and the angled ones every other in a line, straight ones behind a number
    (inches) aside."""
    out, straight, angled = set(), 0, 0
    for k, w in enumerate(words):
        if w == "\n":
            straight = angled = 0
        elif w in "«»":
            angled += 1
            if angled % 2:
                out.add(k)
        elif w == '"':
            if not (k and words[k - 1][-1].isdigit() and straight % 2 == 0):
                straight += 1
                if straight % 2:
                    out.add(k)
        elif w in "“„":
            out.add(k)
    return out


def quoted_at(words: list[str], opening: set[int], at: int, window: int) -> bool:
    """Whether the nearest marks before and behind a word, in its line and within
    the window, open and close a quotation."""
    for low in range(at - 1, max(-1, at - window - 1), -1):
        if words[low] == "\n" or (words[low] in QUOTES and low not in opening):
            return False
        if low in opening:
            break
    else:
        return False
    ends = '"' if words[low] == '"' else "«»" if words[low] in "«»" else "”“"
    for high in range(at + 1, min(len(words), at + window + 1)):
        if words[high] == "\n":
            return False
        if words[high] in QUOTES:
            return words[high] in ends
    return False


def context_factor(words: list[str], opening: set[int], at: int, p: dict) -> float:
    """What a hit at ``words[at]`` is multiplied by."""
    window = p["window"]
    if quoted_at(words, opening, at, window):
        return p["quoted_factor"]
    low, high = at, at
    while low > 0 and at - low < window and words[low - 1] not in ".!?\n":
        low -= 1
    while high + 1 < len(words) and high - at < window and words[high + 1] not in ".!?\n":
        high += 1
    near = words[low : high + 1]
    if any(w in REPORTING for w in near):
        return p["quoted_factor"]
    return p["direct_factor"] if any(w in DIRECT for w in words[max(0, at - window) : at + window + 1]) else 1.0


def score_texts(texts: pa.Array, langs: pa.Array, automata: dict, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(score, hits) of each text."""
    score, hits = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    known: dict = {}  # weight of each distinct word, by language
    for r, (text, lang) in enumerate(zip(texts.to_pylist(), langs.to_pylist(), strict=True)):
        if not text:
            continue
        words = tokens(text)
        weights = known.setdefault(lang, {})
        new = set(words).difference(weights)  # ``- weights.keys()`` would walk all known words for each text
        if new:
            automaton = automata.get(lang) or automata.get("") if lang is not None else automata[None]
            for w in new:
                weight, exact = automaton.match(w)
                weights[w] = weight if exact else weight * p["fuzzy_weight"]
        found = [k for k, w in enumerate(map(weights.__getitem__, words)) if w]
        opening = opening_marks(words) if found else set()
        score[r] = sum(weights[words[at]] * context_factor(words, opening, at, p) for at in found)
        hits[r] = len(found)
    return score, hits


def score(
    docs: DataFrame,
    lexicon: Iterable[Term] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: str = "flagged",
    threshold: float = 1.0,
    fuzzy_weight: float = 0.4,
    quoted_factor: float = 0.2,
    direct_factor: float = 1.25,
    window: int = 6,
    edits: int = 1,
    fuzzy_length: int = 5,
) -> DataFrame:
    """Score documents.  ``lexicon``: (language or None for all, term, weight, kind).

    ``keep="flagged"`` returns ``id, toxicity, n_hits`` of the rejected rows,
    ``"scores"`` of all rows; ``"clean"`` returns the rows, with all their
    columns, that aren't rejected.
    """
    lexicon = list(lexicon if lexicon is not None else [(None, t, 1.0, "fuzzy") for t in BASE_TERMS])
    p = {"fuzzy_weight": fuzzy_weight, "quoted_factor": quoted_factor, "direct_factor": direct_factor, "window": window}
    built: dict = {}

    def automata() -> dict:
        if not built:
            langs = {lg for lg, *_ in lexicon if lg is not None}
            built.update({lg: Automaton(_terms_of(lexicon, lg), edits, fuzzy_length) for lg in langs})
            built[""] = Automaton(_terms_of([x for x in lexicon if x[0] is None], None), edits, fuzzy_length)
            built[None] = Automaton(_terms_of(lexicon, None), edits, fuzzy_length)
        return built

    def judge(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return score_texts(texts.cast(pa.string()), langs.cast(pa.string()), automata(), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "_text")):
            s, h = judge(batch.column("_text"), batch.column("_lang"))
            out = pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(s), pa.array(h)], names=[id_col, "toxicity", "n_hits"])
            yield out.filter(pa.array(s >= threshold)) if keep == "flagged" else out

    names = docs.columns
    text_at, lang_at = f"c{names.index(text_col)}", f"c{names.index(lang_col)}"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text_at)):
            s, _ = judge(batch.column(text_at), batch.column(lang_at))
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(s < threshold))

    if keep == "clean":
        return map_rows(docs, clean, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    name = "`" + id_col.replace("`", "``") + "`"
    picked = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"), quoted(lang_col).alias("_lang"))
    return picked.mapInArrow(run, f"{name} {kind}, toxicity double, n_hits bigint")


def learn_lexicon(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    max_labelled: int = 800,
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7),
    min_share: float = 0.04,
    min_precision: float = 0.97,
    min_toxic: int = 5,
    learned_weight: float = 0.6,
    max_confused: float = 0.05,
) -> list[Term]:
    """Terms and stems that mark toxic documents of each language.

    A bounded fit: at most ``max_labelled`` labelled documents of a language and
    class, those with the lowest hash of their id, are read.  A word or word
    stem is taken when, copies counted once, it occurs in at least ``min_toxic`` and a share
    ``min_share`` of the toxic ones and, of the documents with it, at least a
    share ``min_precision`` (class sizes made equal) is toxic.  Of a stem and its
    extensions the shortest is kept, unless a single word accounts for most of it.  Labels of null ids or classes are ignored.
    """
    from pyspark.sql import Window

    known = labels.select(quoted(id_col).alias("_id"), quoted(label_col).alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    keyed = docs.select(quoted(id_col).alias("_id"), quoted(lang_col).alias("_lang"))
    ranked = keyed.join(known, "_id").withColumn("_n", F.row_number().over(Window.partitionBy("_lang", "_y").orderBy(F.xxhash64("_id"), "_id")))
    chosen = ranked.where(F.col("_n") <= max_labelled).select("_id", "_y")
    text = F.lower(quoted(text_col).cast("string"))
    words = (
        docs.select(quoted(id_col).alias("_id"), quoted(lang_col).alias("_lang"), text.alias("_text"))
        .where("_lang is not null")
        .join(F.broadcast(chosen), "_id")  # at most 2 * max_labelled rows a language
        .select("_id", "_lang", "_y", F.array_distinct(F.regexp_extract_all("_text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    )

    def stems_of(k: int):
        return F.transform(F.filter("w", lambda x: F.length(x) >= k), lambda x: F.concat(F.lit("s"), F.substring(x, 1, k)))

    def hashed(seed: int):
        return F.transform("w", lambda x: F.xxhash64(x, F.lit(seed)))

    parts = F.array_distinct(F.concat(F.transform("w", lambda x: F.concat(F.lit("w"), x)), *[stems_of(k) for k in stem_lengths]))
    for seed in (1, 4):  # of copies, which mostly share three min-wise hashes, one is counted
        words = words.withColumn("_k", F.xxhash64(*[F.array_min(hashed(seed + i)) for i in range(3)])).groupBy("_lang", "_y", "_k").agg(F.min_by("w", "_id").alias("w"), F.min("_id").alias("_id"))
    words = checkpoint(words.select("_lang", "_y", "_id", "w"))
    sizes = {(r[0], bool(r[1])): r[2] for r in words.groupBy("_lang", F.col("_y") > 0).count().collect()}
    if not sizes:
        return []
    counts = (
        words.select("_lang", (F.col("_y") > 0).alias("y"), F.explode(parts).alias("p"))
        .groupBy("_lang", "p")
        .agg(F.count_if("y").alias("n1"), F.count_if(~F.col("y")).alias("n0"))
        .where((F.col("n1") >= min_toxic) | ((F.col("n0") > 0) & F.col("p").startswith("w")))
        .select("_lang", F.substring("p", 2, 1 << 30).alias("t"), F.col("p").startswith("s").alias("stem"), "n1", "n0")
    )
    out: list[Term] = []
    rows = counts.collect()  # at most the words of max_labelled documents a language
    for lang in sorted({r[0] for r in rows}):
        t1, t0 = sizes.get((lang, True), 0), sizes.get((lang, False), 0)
        if not t1 or not t0:
            continue
        good = [(r["t"], r["stem"]) for r in rows if r[0] == lang and r["n1"] >= max(min_toxic, min_share * t1) and (r["n1"] / t1) >= min_precision * (r["n1"] / t1 + r["n0"] / t0)]
        count = {(r["t"], r["stem"]): r["n1"] for r in rows if r[0] == lang}
        words_ = {t for t, stem in good if not stem}
        stems: list[str] = []
        for t in sorted((t for t, stem in good if stem), key=lambda t: (len(t), t)):
            one_word = max((count[w, False] for w in words_ if w.startswith(t)), default=0)
            if one_word < 0.7 * count[t, True] and not any(t.startswith(x) for x in stems):
                stems.append(t)
        out += [(lang, t, learned_weight, "stem") for t in stems]
        learned = [t for t in sorted(words_) if not any(t.startswith(x) for x in stems)]
        plain = [r["t"] for r in rows if r[0] == lang and not r["stem"] and r["n0"] / t0 > r["n1"] / t1]
        near = Automaton({t: (1.0, "fuzzy") for t in [*learned, *BASE_TERMS]})
        close = [w for w in plain if near.match(w) > (0.0, False) and not near.match(w)[1]]
        confused = {t for t in learned if any(Automaton({t: (1.0, "fuzzy")}).match(w)[0] for w in close)}
        vague = len(confused) > max_confused * len(learned)  # misspellings can't be told from other words
        out += [(lang, t, learned_weight, "word" if vague or t in confused else "fuzzy") for t in learned]
        out += [(lang, w, 0.0, "clean") for w in close]
    return out


def detector_lexicon(docs: DataFrame, labels: DataFrame | None, **kw) -> list[Term]:
    """The built-in terms, and those learned from labels where there are any."""
    base: list[Term] = [(None, t, 1.0, "fuzzy") for t in BASE_TERMS]
    return base + (learn_lexicon(docs, labels, **kw) if labels is not None else [])
