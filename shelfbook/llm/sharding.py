"""Sharding by a permutation-filled lookup table: constant-time placement that changes little with the shards.

Each shard has its own order of preference over the slots of a table of prime size, ``(offset + j * skip) mod
slots`` with both numbers hashed from its name. Shards take turns: each claims the first slot of its order that
is still free, a shard of weight ``w`` one slot in each of ``w`` turns of a round. So shards of one weight differ by one slot at most,
and a shard that comes or goes moves few documents beside its own. The table has at most ``MOST_SLOTS``
rows, which bounds what is broadcast; a document's slot is the hash of its id.

Where the id is null the ``fallback`` columns stand in for it, so that rows without an id spread. Rows of one id share
a shard. Every row gives a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 65537
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """(offset, skip) of a shard's order; any skip below a prime reaches every slot."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8]) % slots, int.from_bytes(digest[8:16]) % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[str]:
    """The shard of each slot."""
    if len(set(shards)) != len(shards) or not 1 <= len(shards) <= slots:
        raise ValueError("shards must be distinct, and no more than slots")
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    turns = [shard for shard in sorted(shards) for _ in range((weights or {}).get(shard, 1))]
    if not turns:
        raise ValueError("some shard needs a weight")
    at, step = {}, {}
    for shard in set(turns):
        at[shard], step[shard] = preference(shard, slots)
    table: list[str | None] = [None] * slots
    for claim in range(slots):
        shard = turns[claim % len(turns)]
        while table[at[shard]] is not None:
            at[shard] = (at[shard] + step[shard]) % slots
        table[at[shard]] = shard
    return table


def slot_of(id_column: str, fallback: Sequence[str], slots: int) -> Column:
    other = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fallback])
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_column).cast("string"), other)), F.lit(slots)).cast("int")


def place(
    docs: DataFrame,
    shards: Sequence[str] = SHARDS,
    slots: int = SLOTS,
    weights: Mapping[str, int] | None = None,
    id_column: str = "doc_id",
    fallback: Sequence[str] = ("source", "n_chars"),
) -> DataFrame:
    """The rows of ``docs`` with ``slot`` and ``shard``, which replace columns of these names."""
    slot, shard, at = fresh(docs.columns, "_slot", "_shard", "_at")
    filled = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots, weights))), f"{slot} int, {shard} string")
    held = [c for c in fallback if c in docs.columns]
    placed = docs.withColumn(at, slot_of(id_column, held, slots))
    placed = placed.join(F.broadcast(filled), F.col(at) == F.col(slot))
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*kept, F.col(at).alias("slot"), F.col(shard).alias("shard"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; large shards are written by several tasks."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
