"""URL filters as a sort-merge range join on reversed-host keys.

A URL becomes a canonical key: the host's labels reversed, each with a dot
behind it, the port unless it is 80 or 443, a slash and the path, and a question
mark with the query, where there is one; scheme, user, fragment, case of the
host and a trailing dot don't count.  A rule is parsed like a URL.  A bare host
("example.com", "*.example.com", "http://example.com:443") covers the domain with
all sub-domains and ports; a host with a port, those URLs of the host that have
it; with a path or query, the URLs whose key starts so ("example.com/ads" also
covers "/adsense", by design; "example.com?x=1" is the query of the root).  All
turn into a prefix of keys, that is an interval of them, and intervals nest or
are disjoint.

Keys are range-partitioned by sampled bounds (balance only); a rule goes to each
partition that its interval meets.  Every partition sorts its keys and rules
and sweeps them once, with the active nested rules on a stack; the top of the
stack, the most specific rule, decides.  One key that many rows have is swept
once: rows are joined to the decisions by their key, rows of equal keys in
any number of tasks.

Nulls, ties, odd input: a null or empty URL, or one without a host, matches no
rule (``rule`` null, action ``default_action``); null and empty rules and those
without a host are ignored; of rules with the same key the one with the least
action text decides; repeated URLs are decided each; URLs of any length are
compared whole; an empty table gives an empty result, no rules the default;
other columns of either table are kept or ignored, whatever their names.
Columns added get a leading underscore where the names are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm._util import free_name, quoted, shuffle_partitions

URL = r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:@\s]+?)\.?(:[0-9]*|)(/[^?#\s]*|)(\?[^#\s]*|)(?:#.*)?\s*$"


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """(reversed host, port unless it is a default, path, query); the host is empty where there is none."""
    url = F.coalesce(url, F.lit(""))
    host, port, path, query = (F.regexp_extract(url, URL, k) for k in (1, 2, 3, 4))
    labels = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), "."), F.lit("."))
    return F.when(host != "", labels), F.when(port.isin("", ":", ":80", ":443"), F.lit("")).otherwise(port), path, query


def url_key(url: Column) -> Column:
    """Canonical key, null where there is no host."""
    labels, port, path, query = _parts(url)
    return F.concat(labels, port, F.when(path == "", F.lit("/")).otherwise(path), query)


def rule_key(rule: Column) -> Column:
    """Prefix of the keys that a rule covers; a bare host covers sub-domains too."""
    labels, port, path, query = _parts(F.regexp_replace(F.coalesce(rule, F.lit("")), r"^(\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?)\*?\.", "$1"))
    end = F.when(port != "", F.lit("/")).otherwise(F.lit(""))  # a port is whole: ":80" isn't ":8080"
    return F.concat(labels, port, F.when((path == "") & (query != ""), F.lit("/")).when(path == "", end).otherwise(path), query)


def sweep(keys: list[str], rules: list[tuple[str, str, str]]) -> list[int]:
    """For each of the sorted keys the index of the deepest rule (sorted by
    prefix) that is a prefix of it, or -1."""
    out, stack, nxt = [], [], 0
    for key in keys:
        while nxt < len(rules) and rules[nxt][0] <= key:
            prefix = rules[nxt][0]
            while stack and not prefix.startswith(rules[stack[-1]][0]):
                stack.pop()
            stack.append(nxt)
            nxt += 1
        while stack and not key.startswith(rules[stack[-1]][0]):
            stack.pop()
        out.append(stack[-1] if stack else -1)
    return out


def after(prefix: str) -> str | None:
    """Least string above all that start with ``prefix``, by code points; None if there is none."""
    bare = prefix.rstrip("\U0010ffff")
    if not bare:
        return None
    nxt = ord(bare[-1]) + 1
    return bare[:-1] + chr(0xE000 if 0xD800 <= nxt < 0xE000 else nxt)  # surrogates aren't characters


def apply(urls: DataFrame, rules: DataFrame, url_col: str = "url", rule_col: str = "rule", action_col: str = "action", default_action: str = "allow", sample_rows: int = 20_000) -> DataFrame:
    """``urls`` with ``url_key``, ``rule`` and ``action`` of the most specific rule."""
    spark = urls.sparkSession
    parts = shuffle_partitions(spark)
    key, rule, action = (free_name(urls, c) for c in ("url_key", "rule", "action"))
    keyed = urls.withColumn(key, url_key(quoted(url_col).cast("string")))
    first = Window.partitionBy("_k").orderBy("_a", "_r")
    clean = (
        rules.select(rule_key(quoted(rule_col).cast("string")).alias("_k"), quoted(rule_col).cast("string").alias("_r"), F.coalesce(quoted(action_col).cast("string"), F.lit("block")).alias("_a"))
        .where("_k is not null")
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .drop("_n")
    )
    keys = keyed.select(F.col(key).alias("k")).where("k is not null").distinct()
    n_keys = keys.count()
    share = min(1.0, sample_rows / max(1, n_keys))
    found = sorted(r["k"] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).collect())
    bounds = np.array(sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else [], object)

    @F.pandas_udf("int")
    def place(k):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, k.to_numpy(object), "right").astype(np.int32))

    @F.pandas_udf("array<int>")
    def meets(k):
        import pandas as pd

        low = np.searchsorted(bounds, k.to_numpy(object), "right")
        ends = [after(x) for x in k]
        high = np.array([len(bounds) if e is None else np.searchsorted(bounds, e, "left") for e in ends], np.int64)
        return pd.Series([np.arange(a, b + 1, dtype=np.int32) for a, b in zip(low, high, strict=True)])

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        table = sorted(zip(*(right.column(c).to_pylist() for c in ("_k", "_r", "_a")), strict=True))
        k = sorted(left.column("k").to_pylist())
        hit = [(x, *table[h][1:]) for x, h in zip(k, sweep(k, table), strict=True) if h >= 0]
        return pa.Table.from_arrays([pa.array([x[c] for x in hit], pa.string()) for c in range(3)], names=["k", "r", "a"])

    left = keys.withColumn("_p", place("k"))
    right = clean.withColumn("_q", F.explode(meets("_k")))
    decided = left.groupBy("_p").cogroup(right.groupBy("_q")).applyInArrow(merge, "k string, r string, a string")
    k, r, a = (free_name(keyed, c) for c in ("_k", "_r", "_a"))
    joined = keyed.join(decided.toDF(k, r, a), F.col(key) == F.col(k), "left")
    return joined.select(*[quoted(c) for c in keyed.columns], F.col(r).alias(rule), F.coalesce(F.col(a), F.lit(default_action)).alias(action))
