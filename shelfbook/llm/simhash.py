"""SimHash near-duplicate groups: 64-bit fingerprints linked through BK-trees.

Trees of all fingerprints have no size bound, so none is sent to every task. Instead the fingerprints are
dealt to shards such that any two within the radius meet in one shard: the 64 bits are cut into
``radius + 3`` blocks, two fingerprints that differ in at most ``radius`` bits agree on three blocks, and
there is one shard for each choice of three blocks and each value of theirs. A shard's tree goes to the one
task that asks it. A shard of more than ``SHARD`` fingerprints is dealt again in the same way by the bits that
its choice left open, until none is larger: every choice leaves ``radius / (radius + 3)`` of the open bits, and
fingerprints of a shard differ in open bits only, so at a radius of two no shard holds over 1,024 after two
deals. Every shard is linked by its tree, whatever its size and the radius.

Rows: every input row has a fingerprint, a null or wordless text the fingerprint zero, which links like any
other. Repeated rows stay. A null id takes part in links but is no component id; a component without
any id has a null one. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import bits, bktree, words
from .common import fresh, small_batches
from .components import components

SEED = 42
RADIUS = 2
SHINGLE = 3
SHARD = 4096  # fingerprints of a tree at most, while bits are left to deal them by
AGREED = 3  # blocks that two fingerprints of a shard share
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text, the bits set in over half of its hashes; ``count`` hashes of each text in turn."""
    # Bytes of a word count eight bits at once, in blocks of at most 255 hashes so that no byte overflows.
    blocks = -(-count // 255)
    owner = np.repeat(np.arange(len(count)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(count) - count, blocks) + 255 * number
    ones = np.zeros((len(count), 64), np.int64)
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for bit in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, begin)
            bytes_ = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
            ones[owner[first], bit::8] = np.add.reduceat(bytes_, first, axis=0)
    bits = (2 * ones > count[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def simhash(column: pa.Array) -> np.ndarray:
    """Fingerprints of texts: majority bits of the XXH64 of all their three-word shingles."""
    return majority_bits(*words.shingles(words.split_words(*words.text_bytes(column)), SHINGLE, SEED))


def _printed(plain: DataFrame) -> DataFrame:
    """Columns of ``plain``, whose last is ``text``, with ``fp`` in place of the text."""
    kept = [*plain.columns[:-1], "fp"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                fp = pa.array(simhash(piece.column(len(kept) - 1)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], fp], kept)

    shape = plain.withColumn("fp", F.lit(0).cast("bigint")).drop("text").schema
    return small_batches(plain).mapInArrow(rows, shape)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit number."""
    return _printed(docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")))


def narrower(mask: int, radius: int) -> list[int]:
    """The masks that deal a shard of ``mask`` again: its open bits cut into blocks, three of them more to agree on."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    many = radius + AGREED
    edges = [round(len(free) * i / many) for i in range(many + 1)]
    blocks = [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [mask | sum(three) for three in combinations(blocks, AGREED)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(held: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """(mask, bits, fp) of the fingerprints of ``held`` (mask, fp), dealt by the narrower masks; and these masks.

    The masks depend on the radius alone; fingerprints that come to a mask from several others count once.
    """
    ways = [(_signed(m), [_signed(t) for t in narrower(m, radius)]) for m in masks]
    if len(ways) == 1:
        dealt = held.select(F.explode(F.array(*[F.lit(t) for t in ways[0][1]])).alias("mask"), "fp")
    else:
        table = held.sparkSession.createDataFrame(ways, "mask bigint, ways array<bigint>")
        dealt = held.join(F.broadcast(table), "mask").select(F.explode("ways").alias("mask"), "fp").distinct()
    found = sorted({t for m in masks for t in narrower(m, radius)})
    return dealt.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("bits"), "fp"), found


def _tree_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join the fingerprints of each shard within the radius, by the shard's BK-tree."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) > 1 << 17:  # whole shards only; the last one may go on in the next batch
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                cut = last[-1] + 1 if len(last) else 0
                yield from links(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from links(*held)

    def links(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        changes = np.concatenate([[False], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
        a, b = bktree.Forest(fp.view(np.uint64), np.cumsum(changes)).stars(radius)
        if len(a):
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    dealt = shards.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
    return dealt.mapInArrow(rows, "a bigint, b bigint")


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b), a > b, that connect all distinct fingerprints within ``radius`` of each other."""
    if not 0 <= radius < 64:
        raise ValueError("the radius is a number of bits, 0 to 63")
    shards, masks = _deal(prints.select(F.lit(0).cast("bigint").alias("mask"), "fp"), [0], radius)
    found = None
    while True:
        key, here, open_bits = ["mask", "bits"], shards, 64 - min(m.bit_count() for m in masks)
        # Few open bits mean a small shard, or too few bits to cut.
        crowded = shards.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > shard).drop("n")
        crowded = pin(crowded) if 1 << open_bits > shard and open_bits > max(12, radius + AGREED) else None
        if crowded is not None and not crowded.isEmpty():
            here = shards.join(crowded, key, "left_anti")
        else:
            crowded = None
        trees = _tree_links(here, radius)
        found = trees if found is None else found.union(trees)
        if crowded is None:
            return found
        shards, masks = _deal(shards.join(crowded, key, "left_semi").select("mask", "fp"), masks, radius)


def group_least(rows: DataFrame, value: str, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(fp, least): for every fingerprint of ``rows`` the least ``value`` in all of its group; nulls count last."""
    prints = pin(rows.groupBy("fp").agg(F.min(value).alias("least")))
    roots = components(links(prints.select("fp"), radius, shard))
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("least"))
    return placed.drop("least").join(named, "root").select("fp", "least")


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """(id column, fp, component_id) per row; the component is named by its smallest id."""
    rows = pin(fingerprints(docs, id_column, text_column))
    by_print = group_least(rows, "id", radius, shard).withColumnRenamed("least", "component_id")
    return rows.join(by_print, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def fingerprint_text(fp):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """Keep one row of each group that ``near_groups`` forms: the smallest id with, among its texts, the smallest digest.

    Rows are told apart by id and text (128 bits of it; null counts as empty). Of rows that repeat both, the one
    whose columns sort first stays. Rows without an id come last, and one of them stays where a group has
    no others. A Bloom filter of the rows that go clears most others on the spot, so that few texts are shuffled to meet
    the exact keys.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit(""))))
    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), digest.alias("digest"), F.col(text_column).alias("text"))
    who = F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")
    rows = pin(_printed(plain)).withColumn("who", who)
    judged = rows.join(group_least(rows, "who", radius, shard), "fp").select("id", "digest", (F.col("who") == F.col("least")).alias("stays"))
    the_id, the_digest, whole = fresh(docs.columns, "near_id", "near_digest", "near_whole")
    judged = judged.groupBy(F.col("id").alias(the_id), F.col("digest").alias(the_digest)).agg(F.every("stays").alias("stays"), F.count("*").alias("n"))
    judged = pin(judged.filter("not stays or n > 1"))
    own = F.col(id_column).cast("bigint")
    named = bits.counted(judged.select(F.xxhash64(the_id, the_digest).alias("hash")), size := bits.size_for(judged.count(), 16))
    doubtful = bits.all_set(bits.collect(named, size), F.xxhash64(own, digest), docs.sparkSession)
    here = own.eqNullSafe(F.col(the_id)) & (digest == F.col(the_digest))
    kept = docs.filter(~doubtful).union(docs.filter(doubtful).join(judged.select(the_id, the_digest), here, "left_anti"))
    twice = judged.filter("stays").select(the_id, the_digest)
    if twice.isEmpty():
        return kept
    once = docs.filter(doubtful).join(twice, here).groupBy(the_id, the_digest).agg(F.min(F.struct(*docs.columns)).alias(whole))
    return kept.union(once.select(f"{whole}.*"))
