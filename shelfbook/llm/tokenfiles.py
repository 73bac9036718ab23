"""Token ids in binary files, in ascending order of the document id, with a minimal perfect hash index.

Encoding: the tokenizer file's path is a parameter. Where a vocabulary drops blanks (asked of it by a probe) a text is cut at its ASCII
blanks and the ids of a word are remembered, ``REMEMBERED`` words at most; any other vocabulary encodes whole
texts. Words of plain letters and marks skip the normalizer and the pattern where the file names those that leave them one piece. Each
document ends with the id ``end_id``. A task encodes on its own thread, and holds ``PIECE`` of texts with their words, one block and the
remembered words.

Files: rows are dealt to ordered ranges and sorted, so that every task holds a stretch of the order and cuts it into blocks
of about ``BLOCK`` bytes. A block is one file: ``MAGIC``, a head (``HEAD``: bytes of an id, task, number in the
task, documents, ids), then of its documents a byte that says whether the id is null, the id and the number of token ids, then the
raw token ids, little-endian, two bytes each where the vocabulary allows, then ``MAGIC_END``. Files are written by
Spark's text writer, whose line end is ``MAGIC_END``, so they reach any store that Spark reaches, and a lost task writes its
files again. Beside them lie ``blocks`` (place of every block in the whole) and ``index``.

Index: a document's key is its id and its number among the rows of this id, in file order. Keys are dealt by a hash to tables of about
``KEYS`` keys; each is a minimal perfect hash (``mph``) whose slots hold a fingerprint, the block, and
offset and length in it. ``locate`` finds keys in constant time each, ``fetch`` returns their ids and reads no other block.

A null text is empty and has the end id alone. Null ids come last in the order; rows of one id stand by the hash of
their text. Repeated rows are documents of their own. Columns other than the id and the text are
ignored. An empty table gives no file and no row. A document's ids must fit a row of Spark, 2 GB.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from ..functions.keys import running_totals
from ..session import pin, scratch_folder
from . import mph, words
from .common import small_batches

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK = 16 << 20  # bytes of token ids in a file, beyond which it ends with its document
KEYS = 1 << 12  # of an index table, on average
REMEMBERED = 1 << 19  # words whose ids a worker keeps, beside those of the batch at hand
MOST_MARKS = 1 << 14  # runs of marks whose ids a worker keeps
LONGEST_WORD = 40  # bytes of a word that is remembered
PIECE = 1 << 20  # bytes of texts that are encoded together
LONG_TEXT = 1 << 20  # bytes of a text that is encoded in parts
CARRIED = 2 << 20  # bytes of rows that Arrow carries to a worker at a time, beyond which a batch ends with its row
FEW_BLOCKS = 1000  # that ``fetch`` opens by name
MOST_BYTES = 64 << 20  # of a vocabulary file, which every task gets
MAGIC, MAGIC_END = b"IDBLOCK1", "IDBLOCK/"
HEAD = struct.Struct("<IQQQQ")
BLANKS = " \t\n\v\f\r"
_MARK = "\x01"
# Fixed values of a vocabulary whose words of letters are one piece: its normalizer, pattern and pieces.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters of Latin-1 in lower case, and marks around them; both are pieces of their own. An apostrophe is none of the marks,
# nor are those of special tokens.
LETTERS = re.compile(r"^(?:(?!.*<\|)[!-&(-/:-@\[-`{-~]*([a-z\u00df-\u00f6\u00f8-\u00ff]+)[!-&(-/:-@\[-`{-~]*|.*)$", re.MULTILINE)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian bytes, ``width`` bytes an id."""

    def __init__(self, content: bytes):
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # One beyond the highest id, which may belong to an added token behind gaps.
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.drops_blanks = all(not one(b) and one(f"ab{b}.c") == one("ab") + one(".c") for b in BLANKS) and len(one(_MARK)) == 1
        self.mark = one(_MARK)[0] if self.drops_blanks else None
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.quick, self.last = None, None
        said = json.loads(content)
        suffix = said["model"].get("end_of_word_suffix")
        cut = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        by_pattern = cut[0].get("pattern") == {"Regex": PATTERN} and cut[0].get("behavior") == "Removed" and cut[0].get("invert") is True
        by_bytes = len(cut) == 2 and cut[1].get("type") == "ByteLevel" and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex")
        if self.drops_blanks and suffix and by_pattern and by_bytes and (said.get("normalizer") or {}).get("normalizers") == NORMALIZER:
            self.quick = Tokenizer(self.tokenizer.model)
            self.quick.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.size, bool)  # ids that end a word
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _ids(self, texts: list[str], by: Tokenizer | None = None) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, words_: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[bytes, bytes]:
        raw, size = ids.tobytes(), self.dtype.itemsize
        if len(starts) != len(words_):
            raise ValueError("the vocabulary does not keep words apart")
        return {w: raw[size * a : size * b] for w, a, b in zip(words_, starts.tolist(), ends.tolist(), strict=True)}

    def _by_mark(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of any words, many in one text with a mark between; words that hold the mark go alone."""
        plain = [w for w in missing if _MARK.encode() not in w]
        alone = [w for w in missing if _MARK.encode() in w]
        found = dict(zip(alone, (x.tobytes() for x in self._ids([w.decode() for w in alone])), strict=True))
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for group, ids in zip(groups, self._ids([f" {_MARK} ".join(w.decode() for w in g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.mark)
            found |= self._cut(group, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))
        return found

    def _of_letters(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of words of letters in lower case, which are one piece each."""
        found, groups = {}, [missing[i : i + 512] for i in range(0, len(missing), 512)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups], self.quick), strict=True):
            ends = np.flatnonzero(self.last[ids]) + 1
            found |= self._cut(group, ids, np.append(0, ends[:-1]), ends)
        return found

    def _of_marks(self, marks: str) -> bytes:
        """Ids of a run of marks; there are few, so each is encoded when it first comes up."""
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) >= MOST_MARKS:
                self.marks.clear()
            ids = self.marks[marks] = self._ids([marks])[0].tobytes()
        return ids

    def _of_words(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words; those of letters with marks around are put together from these pieces."""
        if not self.quick or not missing:
            return self._by_mark(missing)
        low = b"\n".join(missing).decode().lower()
        cores = LETTERS.findall(low)
        by_letters = self._of_letters([*{*cores} - {""}])
        found, odd = {}, []
        for word, line, core in zip(missing, low.split("\n"), cores, strict=True):
            if not core:
                odd.append(word)
                continue
            ids = by_letters[core]
            if len(line) != len(core):
                before, _, behind = line.partition(core)
                if before:
                    ids = self._of_marks(before) + ids
                if behind:
                    ids += self._of_marks(behind)
            found[word] = ids
        return found | self._by_mark(odd)

    def _of_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a text column's words, and where those of each text begin and end.

        Distinct words are found by Arrow, looked up once each, and their ids put in the words' places by whole arrays.
        """
        lists = pc.ascii_split_whitespace(column)
        cut = lists.flatten().dictionary_encode()
        distinct = cut.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.known.get, distinct)]
        missing = [w for w, known in zip(distinct, ids, strict=True) if known is None]
        if missing:
            found = self._of_words(missing)
            ids = [found[w] if known is None else known for w, known in zip(distinct, ids, strict=True)]
            if len(self.known) + len(found) > REMEMBERED:
                self.known.clear()
            self.known |= {w: found[w] for w in missing if len(w) <= LONGEST_WORD}
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        word = cut.indices.to_numpy()
        many = size[word]
        ends = np.cumsum(many)
        place = np.repeat(first[word] - (ends - many), many) + np.arange(many.sum())
        offsets = lists.offsets.to_numpy()
        return np.frombuffer(b"".join(ids), self.dtype)[place], np.append(0, ends)[offsets - offsets[0]]

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a text column, one text behind the other, and where each text's begin and the last's end."""
        column = column.cast(pa.string()).fill_null("")
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        if not self.drops_blanks:
            found = self._ids(column.to_pylist())
            return np.concatenate(found), np.cumsum([0, *map(len, found)])
        if len(column) > 1 or pc.binary_length(column[0]).as_py() <= LONG_TEXT:
            return self._of_column(column)
        parts = [self._of_column(pa.array([part], pa.string()))[0] for part in words.stretches(column[0].as_py().encode(), LONG_TEXT)]
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text as bytes."""
        found, at = self.tokens(pa.array(texts, pa.string()))
        return [found[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    return Encoder(content)


def _vocabulary(spark: SparkSession, path: str | None):
    with open(path or vocabulary_path(), "rb") as file:
        content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError("the vocabulary is too large to hand to every task")
    return spark.sparkContext.broadcast(content)


def pack(dtype: np.dtype, task: int, number: int, ids: list[int | None], tokens: list[bytes]) -> bytes:
    """A block but for its end, which the writer adds."""
    lengths = np.array([len(t) // dtype.itemsize for t in tokens], "<u8")
    keys = np.array([0 if i is None else i for i in ids], "<i8")
    nulls = np.array([i is None for i in ids], np.uint8)
    head = HEAD.pack(dtype.itemsize, task, number, len(ids), int(lengths.sum()))
    return b"".join([MAGIC, head, nulls.tobytes(), keys.tobytes(), lengths.tobytes(), *tokens])


def unpack(data: memoryview) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(task, number, null flags, ids, lengths, token ids) of a block, which must be whole."""
    first = len(MAGIC) + HEAD.size
    if len(data) < first or bytes(data[: len(MAGIC)]) != MAGIC:
        raise ValueError("no block of token ids")
    width, task, number, docs, tokens = HEAD.unpack(data[len(MAGIC) : first])
    end = first + 17 * docs + width * tokens
    if bytes(data[end:]) != MAGIC_END.encode():
        raise ValueError("a block of token ids is cut short")
    nulls = np.frombuffer(data[first : first + docs], bool)
    ids = np.frombuffer(data[first + docs : first + 9 * docs], "<i8")
    lengths = np.frombuffer(data[first + 9 * docs : first + 17 * docs], "<u8").astype(np.int64)
    return task, number, nulls, ids, lengths, np.frombuffer(data[first + 17 * docs : end], f"<u{width}")


def packed_blocks(batches: Iterator[pa.RecordBatch], coder: Encoder, task: int = 0, end_id: int = END_ID, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The documents of (id, text) batches as packed blocks, one in a batch. While a reader has a block, nothing else holds its ids."""
    dtype = coder.dtype if end_id < 1 << 16 else np.dtype("<u4")
    end = np.array([end_id], dtype).tobytes()
    ids: list[int | None] = []
    tokens: list[bytes] = []
    held, number = 0, 0

    def full() -> pa.RecordBatch:
        nonlocal ids, tokens, held, number
        data = pack(dtype, task, number, ids, tokens)
        ids, tokens, held, number = [], [], 0, number + 1
        ends = pa.py_buffer(np.array([0, len(data)], "<i4"))
        return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(data)])], ["value"])

    for batch in batches:
        for piece in words.pieces(batch, "text", PIECE):
            found, at = coder.tokens(piece.column(1))
            found = found.astype(dtype, copy=False)
            for key, first, last in zip(piece.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if ids and held + (last - first) * dtype.itemsize > block:
                    yield full()
                ids.append(key)
                tokens.append(found[first:last].tobytes() + end)
                held += len(tokens[-1])
    if ids:
        yield full()


def write_ids(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    block: int = BLOCK,
) -> None:
    """Write the blocks of all documents under ``path/ids``."""
    shared = _vocabulary(docs.sparkSession, vocabulary)
    if not 0 <= end_id < 1 << 32:
        raise ValueError("the end id must be a token id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tokenizer's own threads would be as many as the machine has cores, in every task, each with memory of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        yield from packed_blocks(batches, encoder(shared.value), TaskContext.get().partitionId(), end_id, block)

    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    # Rows of one id, and copies of one text among them, may fall into several ranges.
    order = [F.col("id").isNull(), F.col("id"), F.xxhash64("text"), F.col("spread")]
    dealt = plain.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = small_batches(dealt.select("id", "text"), 2000, CARRIED).mapInArrow(rows, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", MAGIC_END).option("maxRecordsPerFile", 1).text(
        f"{path}/ids"
    )


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    shape = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.read.format("binaryFile").schema(shape).option("pathGlobFilter", "part-*").load(paths).select("path", "content")


DOCUMENT = "file string, task bigint, number bigint, id bigint, copy bigint, offset bigint, n_tokens bigint, ids_crc32 bigint, first boolean, last boolean"


def checksums(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[int]:
    """CRC-32 of each document's ids as four-byte numbers, widened a document at a time."""
    return [zlib.crc32(tokens[a : a + n].astype("<u4")) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the files: place, length, and CRC-32 of its ids as four-byte numbers.

    ``copy`` counts the rows of the id before it in its block; ``first`` and ``last`` say that the block begins and ends with this id.
    """
    names = [field.split()[0] for field in DOCUMENT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                if not len(data):  # what Spark writes for an empty table
                    continue
                task, number, nulls, ids, lengths, tokens = unpack(data)
                offsets = np.cumsum(lengths) - lengths
                crc = checksums(tokens, offsets, lengths)
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])
                heads = np.flatnonzero(fresh)
                run = np.cumsum(fresh) - 1
                one = lambda value, kind: pa.array([value] * len(ids), kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        one(name.as_py(), pa.string()), one(task, pa.int64()), one(number, pa.int64()),
                        pa.array(ids.astype(np.int64), mask=nulls), pa.array(np.arange(len(ids)) - heads[run]),
                        pa.array(offsets), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(run == 0), pa.array(run == run[-1]),
                    ],
                    names,
                )

    return small_batches(_files(spark, f"{path}/ids"), 2000, CARRIED).mapInArrow(rows, DOCUMENT)


def place_documents(documents: DataFrame, path: str) -> DataFrame:
    """Number the blocks, write them to ``path/blocks`` and return (id, copy, block, offset, n_tokens, ids_crc32, start).

    Blocks are numbered by task and number; ``start`` counts the ids before a document, ``copy`` the rows of its id
    before it, in all files.
    """
    at = ["task", "number"]
    blocks = documents.groupBy(*at).agg(F.any_value("file").alias("file"), F.sum("n_tokens").alias("ids"), F.count("*").alias("docs"))
    blocks = running_totals(blocks.withColumn("one", F.lit(1)), at, {"upto": "ids", "block": "one"}, kind="bigint")
    blocks.select(*at, "block", "file", "docs", "ids", (F.col("upto") - F.col("ids")).alias("start")).write.parquet(f"{path}/blocks")
    blocks = documents.sparkSession.read.parquet(f"{path}/blocks")
    # Only the first and the last id of a block can go on from or in another.
    runs = documents.filter("first or last").groupBy(*at, "id").agg(F.count("*").alias("rows"), F.any_value("first").alias("first"))
    summed = running_totals(runs, at, {"upto": "rows"}, ["id"], "bigint")
    carried = pin(summed.filter("first").select(*at, (F.col("upto") - F.col("rows")).alias("earlier")).filter("earlier > 0"))
    placed = documents.join(blocks.select(*at, "block", "start"), at).join(carried, at, "left")
    earlier = F.when(F.col("first"), F.coalesce("earlier", F.lit(0))).otherwise(0)
    return placed.select(
        "id", (F.col("copy") + earlier).alias("copy"), "block", "offset", "n_tokens", "ids_crc32", (F.col("start") + F.col("offset")).alias("start")
    )


def _key(id_column: str = "id", copy_column: str = "copy") -> list:
    """The two numbers of a key; a null id is apart from every id by the second."""
    nameless = F.col(id_column).isNull().cast("bigint")
    return [F.coalesce(id_column, F.lit(0)).alias("k_id"), (F.shiftleft(nameless, 62) + F.col(copy_column)).alias("k_copy")]


def _table_of(tables: int):
    return F.pmod(F.xxhash64("k_id", "k_copy"), F.lit(tables)).alias("table")


INDEX = "table bigint, levels array<binary>, prints binary, block binary, offset binary, n_tokens binary"


def write_index(placed: DataFrame, path: str, keys: int = KEYS) -> None:
    """Write the hash tables of all documents to ``path/index``; their number is in its folder's name."""

    def one(table: pa.Table) -> pa.Table:
        get = lambda name: table.column(name).to_numpy()
        levels = mph.build(get("k_id"), get("k_copy"))
        slot = levels.slots(get("k_id"), get("k_copy"))

        def by_slot(values: np.ndarray) -> bytes:
            out = np.empty_like(values)
            out[slot] = values
            return out.tobytes()

        held = [by_slot(mph.fingerprints(get("k_id"), get("k_copy"))), *[by_slot(get(c)) for c in ("block", "offset", "n_tokens")]]
        row = [[table.column("table")[0].as_py()], [levels.packed], *[[x] for x in held]]
        kinds = [pa.int64(), pa.list_(pa.binary()), *[pa.binary()] * 4]
        return pa.table([pa.array(x, kind) for x, kind in zip(row, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    tables = max(1, -(-placed.count() // keys))
    dealt = placed.select(*_key(), "block", "offset", "n_tokens").select(_table_of(tables), "*")
    dealt.groupBy("table").applyInArrow(one, INDEX).withColumn("tables", F.lit(tables)).write.parquet(f"{path}/index")


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (id, copy, more columns) that the index holds, with ``block``, ``at`` and ``length``.

    Equal keys must not fill a task: ``keys`` should be distinct. A key that is not indexed passes a fingerprint
    with a chance of one in four thousand million.
    """
    index = spark.read.schema(f"{INDEX}, tables int").parquet(f"{path}/index")
    any_row = index.select("tables").first()
    tables = any_row.tables if any_row else 1
    asked = keys.select(*keys.columns, *_key()).select(*keys.columns, "k_id", "k_copy", _table_of(tables))
    shape = asked.select(*keys.columns, *[F.lit(0).cast("bigint").alias(c) for c in ("block", "at", "length")]).schema

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        kept = left.select(keys_columns)
        if not right.num_rows or not left.num_rows:
            found = np.zeros((3, 0), np.int64)
            kept = kept.slice(0, 0)
        else:
            row = right.to_pylist()[0]
            ids, copies = left.column("k_id").to_numpy(), left.column("k_copy").to_numpy()
            slot = mph.Levels(row["levels"]).slots(ids, copies)
            known = slot >= 0
            known[known] = np.frombuffer(row["prints"], np.uint32)[slot[known]] == mph.fingerprints(ids[known], copies[known])
            kept = kept.filter(pa.array(known))
            found = np.stack([np.frombuffer(row[c], np.int64)[slot[known]] for c in ("block", "offset", "n_tokens")])
        return pa.table([*kept.columns, *[pa.array(x) for x in found]], names=[*keys_columns, "block", "at", "length"])

    keys_columns = list(keys.columns)
    return asked.groupBy("table").cogroup(index.drop("tables").groupBy("table")).applyInArrow(one, shape)


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(id, copy, tokens) of the distinct ``keys`` (id, and copy if named) that the files hold."""
    asked = keys.select(F.col("id").cast("bigint").alias("id"), (F.col("copy") if "copy" in keys.columns else F.lit(0)).cast("bigint").alias("copy"))
    found = pin(locate(spark, path, asked.distinct()))
    named = found.join(spark.read.parquet(f"{path}/blocks").select("block", "file"), "block")
    wanted = pin(named.select("file").distinct())
    few = [row.file for row in wanted.limit(FEW_BLOCKS + 1).collect()]
    if not few:
        return found.select("id", "copy", F.array().cast("array<bigint>").alias("tokens"))
    files = _files(spark, few) if len(few) <= FEW_BLOCKS else _files(spark, f"{path}/ids").join(wanted, F.col("path") == F.col("file"), "left_semi")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        cut = []
        if left.num_rows and right.num_rows:
            tokens = unpack(memoryview(right.column("content")[0].as_buffer()))[-1].astype(np.int64)
            cut = [tokens[a : a + n] for a, n in zip(left.column("at").to_pylist(), left.column("length").to_pylist(), strict=True)]
        kept = left.slice(0, len(cut))
        return pa.table([kept.column("id"), kept.column("copy"), pa.array(cut, pa.list_(pa.int64()))], names=["id", "copy", "tokens"])

    asked_of = named.select(F.col("file").alias("path"), "id", "copy", "at", "length")
    return asked_of.groupBy("path").cogroup(files.groupBy("path")).applyInArrow(one, "id bigint, copy bigint, tokens array<bigint>")


def round_trip(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", **options) -> DataFrame:
    """Write files and index, read the files back, and return (id column, copy, start, n_tokens, ids_crc32) of what the index names.

    A document whose place in the index is not where the files have it is an error.
    """
    spark = docs.sparkSession
    path = path or scratch_folder(spark)
    keys = options.pop("keys", KEYS)
    write_ids(docs, path, id_column, **options)
    placed = pin(place_documents(pin(read_documents(spark, path)), path))
    write_index(placed, path, keys)
    right = (F.col("at") == F.col("offset")) & (F.col("length") == F.col("n_tokens"))
    found = locate(spark, path, placed.withColumnRenamed("block", "read_block"))
    checked = F.when(right & (F.col("block") == F.col("read_block")), F.col("start")).otherwise(
        F.raise_error(F.lit("the index names another place than the files")).cast("bigint")
    )
    return found.select(F.col("id").alias(id_column), "copy", checked.alias("start"), "n_tokens", "ids_crc32")
