"""Sharding: consistent placement through a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, given by
an offset and a step hashed from its name.  The shards take turns (a shard of
weight w gets w turns a round); each claims the first free slot of its
permutation until the table is full.  Placing a row is one hash, one remainder
and one look-up in the broadcast table, whose size is fixed by ``table_size``
and doesn't grow with the data.

Nulls, ties, odd input: a null key goes to the slot of the empty key, equal keys
always go to the same shard, repeated rows are kept; an empty table gives an
empty result.  The columns added are renamed (a leading underscore) where the
table has them already.  Shard names must be distinct and non-empty.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm._util import free_name, quoted


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: dict[str, int] | list[str], table_size: int = 65537) -> np.ndarray:
    """Number of the shard (in sorted name order) that owns each slot."""
    weights = dict.fromkeys(shards, 1) if not isinstance(shards, dict) else shards
    names = sorted(weights)
    if not names or len(set(shards)) != len(list(shards)) or any(not s or weights[s] < 0 for s in names) or not any(weights.values()):
        raise ValueError("distinct, non-empty shard names with weights of at least 0, one of them positive")
    if not is_prime(table_size) or table_size < sum(weights.values()):
        raise ValueError("table_size must be a prime, no smaller than the weights' sum")
    offset = [xxhash.xxh3_64_intdigest(s, seed=1) % table_size for s in names]
    step = [xxhash.xxh3_64_intdigest(s, seed=2) % (table_size - 1) + 1 for s in names]
    table, nxt, filled = np.full(table_size, -1, np.int32), [0] * len(names), 0
    while True:
        for k, s in enumerate(names):
            for _ in range(weights[s]):
                slot = (offset[k] + nxt[k] * step[k]) % table_size
                while table[slot] >= 0:
                    nxt[k] += 1
                    slot = (offset[k] + nxt[k] * step[k]) % table_size
                table[slot] = k
                nxt[k] += 1
                filled += 1
                if filled == table_size:
                    return table


def slot_of(key: Column, table_size: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(table_size)).cast("int")


def place(df: DataFrame, shards: dict[str, int] | list[str], key_col: str = "doc_id", table_size: int = 65537) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard``; no shuffle."""
    names, table = sorted(shards), lookup_table(shards, table_size)
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    owner = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<int>")  # folded to one constant
    label = F.array(*[F.lit(s) for s in names])
    placed = df.withColumn(slot, slot_of(quoted(key_col), table_size))
    return placed.withColumn(shard, F.element_at(label, F.element_at(owner, F.col(slot) + 1) + 1))
