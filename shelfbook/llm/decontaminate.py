"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over ``SPAN`` words that ignores some places, so a window hashes alike where only ignored
words differ. Windows of benchmark items and of documents are joined on (mask, hash), and every hit is
verified on the words around it: it counts if some ``OVERLAP`` aligned words (or a whole item that has
fewer) hold at least ``MATCH`` percent equal words. The masks leave out every pair of places of a window of
``OVERLAP`` words at some shift, and items with fewer words have masks of their own that leave out as many places as
may differ there, so no pattern of changes that counts can hide a hit. Items under ``FEWEST`` words are looked for
as wholes, word by word; those under ``fewest`` words (a parameter, ``WHOLE`` unless given) are left out, as common speech
would hold them.

Few document windows share a hash with the benchmark, so a Bloom filter of the benchmark's hashes, of
bounded size however large the benchmark is, goes to all tasks and lets the others drop out before the join.
What passes by chance fails the join; nothing is lost. Words around each hit travel along, 4 bytes each.

Words are runs of letters and digits in lower case, so neither case nor marks around words hide a leak; any
character beyond ASCII counts as a letter. In scripts that put no blanks between words every character is a word.

A null text has no words. A null id is an id like any other: its rows share one result row. Repeated rows
count once. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from . import words
from .common import fresh, small_batches

# Places of 10 words that count (1) or are ignored (0): any two of 13 words fall on ignored or outer places of some mask.
MASKS = ("1101010111", "1100111101", "1110110011", "1010011111")
SPAN = 10
# The same for whole items of fewer words: any two places of 10 to 12 words, any one of 8 or 9.
SHORT = {
    8: ("1111101", "1101111", "10110111"),
    9: ("1101111", "111010011"),
    10: ("1111011", "11001111", "110101011", "110110011", "111111"),
    11: ("1110111", "110100111", "11101011", "1010010111"),
    12: ("11101011", "1101000111", "110000011101"),
}
OVERLAP = 13
MATCH = 80  # percent
FEWEST = 8
WHOLE = 4
# Thai, Lao, Burmese, Khmer, kana and Chinese characters.
UNBLANKED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"
AROUND = SPAN + 2 * (OVERLAP - 1)  # words that travel with a hit
LEAST_BITS, MOST_BITS = 20, 28  # of the filter: 128 KB to 32 MB
_WORD_SEED = 11
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(5).integers(0, 1 << 63, OVERLAP, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(word: np.ndarray, start: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words of each window; ``start`` numbers the windows' first words."""
    with np.errstate(over="ignore"):
        sums = np.full(len(start), len(mask) + (int(mask, 2) << 8), np.uint64)
        for i, kept in enumerate(mask):
            if kept == "1":
                sums += word[start + i] * _ODD[i]
        sums = (sums ^ (sums >> np.uint64(32))) * _MIX
        return sums ^ (sums >> np.uint64(29))


def _starts(first: np.ndarray, span: int) -> np.ndarray:
    """First words of all windows of ``span`` words that stay in their text."""
    many = np.maximum(np.diff(first) - span + 1, 0)
    return np.repeat(first[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _needed(size: int) -> int:
    """Equal words that an item of ``size`` words asks for."""
    return size if size < FEWEST else -(-min(size, OVERLAP) * MATCH // 100)


def _masks(size: int) -> tuple[str, ...]:
    """The masks of items of ``size`` words."""
    return ("1" * size,) if size < FEWEST else SHORT.get(size, MASKS)


def _spaced(text_column: str) -> Column:
    """The text in lower case, with blanks around the characters that are words."""
    low = F.lower(text_column)
    return F.when(low.rlike(UNBLANKED), F.regexp_replace(low, UNBLANKED, " $1 ")).otherwise(low)


def _around(word: np.ndarray, first: np.ndarray, text: np.ndarray, start: np.ndarray, outside: int) -> np.ndarray:
    """The words around each window as rows of 4-byte marks; ``outside`` marks places beyond the text."""
    at = start[:, None] + np.arange(-(OVERLAP - 1), SPAN + OVERLAP - 1)
    inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
    marks = (word >> np.uint64(32)).astype(np.uint32) | np.uint32(2)  # never a mark of places beyond
    return np.where(inside, marks[np.clip(at, 0, len(word) - 1)], np.uint32(outside))


def _rows(marks: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * AROUND), len(marks), [None, pa.py_buffer(np.ascontiguousarray(marks))]).cast(pa.binary())


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", fewest: int = WHOLE) -> DataFrame:
    """(hash, item, needed, around) of every window; alike windows count once, under the smallest item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                found = words.split_words(*words.text_bytes(piece.column(1)), words.MARKS)
                word = words.xxh64(found.data, found.start, found.end, _WORD_SEED)
                sizes = np.diff(found.first)
                for n in np.unique(sizes[sizes >= max(1, fewest)]):
                    for mask in _masks(int(n)):
                        start = _starts(found.first, len(mask))
                        text = np.searchsorted(found.first, start, "right") - 1
                        start, text = start[sizes[text] == n], text[sizes[text] == n]
                        needed = np.full(len(start), _needed(int(n)), np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(_hashes(word, start, mask).view(np.int64)),
                                piece.column(0).take(pa.array(text)),
                                pa.array(needed),
                                _rows(_around(word, found.first, text, start, 1)),
                            ],
                            ["hash", "item", "needed", "around"],
                        )

    plain = benchmark.select(F.col(id_column).cast("bigint").alias("id"), _spaced(text_column).alias("text"))
    windows = plain.mapInArrow(rows, "hash bigint, item bigint, needed int, around binary")
    return windows.groupBy("hash", "needed", "around").agg(F.min("item").alias("item"))


def bloom(windows: DataFrame) -> tuple[np.ndarray, int]:
    """The filter, and its number of bits as a power of two.

    At most 2**MOST_BITS bits reach the driver, however many windows there are.
    """
    many = windows.select("hash").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * many).bit_length()))
    both = windows.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 64 - bits))).alias("p"))
    places = both.select(F.col("p").bitwiseAND(F.lit((1 << bits) - 1)).alias("p"))
    cells = places.groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    filled = np.zeros(1 << (bits - 6), np.int64)
    for row in cells.toLocalIterator():
        filled[row.cell] = row.bits
    return filled.view(np.uint64), bits


def candidates(
    docs: DataFrame, filled: np.ndarray, bits: int, masks: list[str], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(hash, id, place, around) of the document windows that pass the filter."""
    cells = docs.sparkSession.sparkContext.broadcast(filled)

    def passing(hashes: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << bits) - 1)
        at = np.arange(len(hashes))
        for place in (lambda h: h & low, lambda h: h >> np.uint64(64 - bits)):
            p = place(hashes[at])
            at = at[(cells.value[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        return at

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                found = words.split_words(*words.text_bytes(piece.column(1)), words.MARKS)
                word = words.xxh64(found.data, found.start, found.end, _WORD_SEED)
                for mask in masks:
                    start = _starts(found.first, len(mask))
                    hashes = _hashes(word, start, mask)
                    at = passing(hashes)
                    if not len(at):
                        continue
                    text = np.searchsorted(found.first, start[at], "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes[at].view(np.int64)),
                            piece.column(0).take(pa.array(text)),
                            pa.array(start[at] - found.first[text]),
                            _rows(_around(word, found.first, text, start[at], 0)),
                        ],
                        ["hash", "id", "place", "around"],
                    )

    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), _spaced(text_column).alias("text"))
    return small_batches(plain).mapInArrow(rows, "hash bigint, id bigint, place bigint, around binary")


def verified(hits: DataFrame) -> DataFrame:
    """(id, item, place, equal) of the hits whose surroundings agree well enough."""

    def marks(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, AROUND)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            same = marks(batch.column("around")) == marks(batch.column("item_around"))
            run = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
            best = (run[:, OVERLAP:] - run[:, :-OVERLAP]).max(1)
            ok = pa.array(best >= batch.column("needed").to_numpy())
            kept = [batch.column(c).filter(ok) for c in ("id", "item", "place")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best.astype(np.int32)).filter(ok)], ["id", "item", "place", "equal"])

    return hits.mapInArrow(rows, "id bigint, item bigint, place bigint, equal int")


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", fewest: int = WHOLE) -> DataFrame:
    """One row per contaminated document: its id, the items found in it, the first place and the best overlap.

    ``item_id`` is the smallest item found; ``n_items`` counts items that differ where they were found.
    """
    tests = pin(benchmark_windows(benchmark, fewest=fewest))
    filled, bits = bloom(tests)
    short = {row.needed for row in tests.select("needed").distinct().collect()}  # OVERLAP values at most
    masks = sorted({m for n in range(max(1, fewest), OVERLAP + 1) if _needed(n) in short for m in _masks(n)})
    hits = candidates(docs, filled, bits, masks, id_column).join(tests.withColumnRenamed("around", "item_around"), "hash")
    found = verified(hits)
    by_item = found.groupBy("id", "item").agg(F.min("place").alias("place"), F.max("equal").alias("equal"))
    by_doc = by_item.groupBy("id").agg(
        F.min("item").alias("item_id"), F.count("*").alias("n_items"), F.min("place").alias("first_word"), F.max("equal").alias("equal_words")
    )
    return by_doc.withColumnRenamed("id", id_column)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, fewest: int = WHOLE) -> DataFrame:
    """The rows without benchmark text. Each row is judged by its own text, whatever its id or other rows of that id."""
    texts = docs.select(F.xxhash64("text").alias("row"), "text")
    (mark,) = fresh(docs.columns, "_text_hash")
    bad = pin(leaks(texts, benchmark, "row", fewest).select(F.col("row").alias(mark)))
    return docs.join(bad, F.xxhash64("text") == F.col(mark), "left_anti")
