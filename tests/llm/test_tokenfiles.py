"""Token files and their index against whole encodings of every text."""

from __future__ import annotations

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfbook.llm import mph, queries, tokenfiles
from shelfbook.llm.common import small_batches

SF_DIR = "/root/testdata/sf0.001"
WHOLE = Tokenizer.from_file(tokenfiles.vocabulary_path())
CODER = tokenfiles.Encoder(open(tokenfiles.vocabulary_path(), "rb").read())


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows):
    """(doc_id, start, n_tokens, crc) in ascending order; rows of one id may stand in any order among themselves."""
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = ids_of(text)
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ODD = ["", " ", "\x01", "a\x01b \x01 c", "<|endoftext|>", "x<|EndOfText|>y <|startoftext|>", "H̱ é ́e", "ΣΑΣ ΟΔΟΣ", "İI K",
       "a b c\x85d", "don't  'S 'Re", "\x00\x1c\x1f", "日本語 text", "Éa, été. été Été! (x) y) z.) a'.  K. Å ﬁ Ⅷ", "é" * 50 + " " + "q" * 300, "...!!! ,a,b."]


def test_words_by_words_equal_whole_texts():
    assert CODER.drops_blanks and CODER.quick
    for text, found in zip(ODD, CODER.encode(ODD), strict=True):
        assert np.frombuffer(found, CODER.dtype).tolist() == ids_of(text)[:-1], text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n\t\x0b\x01'.sSéÉ<|>"), max_size=40), max_size=4))
def test_any_texts_equal_whole_texts(texts):
    assert [np.frombuffer(x, CODER.dtype).tolist() for x in CODER.encode(texts)] == [ids_of(t)[:-1] for t in texts]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(tokenfiles, "LONG_TEXT", 20)
    text = " ".join(ODD) + " " + "z" * 100 + " end"
    assert np.frombuffer(CODER.encode([text])[0], CODER.dtype).tolist() == ids_of(text)[:-1]
    assert CODER.encode([]) == [] and CODER.encode([None, "", "a"])[:2] == [b"", b""]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 5)
    coder = tokenfiles.Encoder(open(tokenfiles.vocabulary_path(), "rb").read())
    for text in ["a b c d", "e f a b", "g h i j k l m n", "a n g"] * 2:
        assert np.frombuffer(coder.encode([text])[0], coder.dtype).tolist() == ids_of(text)[:-1]
        assert len(coder.known) <= 10  # those of one batch, or as many as are remembered


def test_a_vocabulary_that_keeps_blanks_encodes_whole_texts():
    path = tokenfiles.vocabulary_path("byte_bpe_50k.json")
    coder, whole = tokenfiles.Encoder(open(path, "rb").read()), Tokenizer.from_file(path)
    assert not coder.drops_blanks
    texts = ["a  b\n c", None, "", *ODD]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_slots_are_minimal_and_strangers_are_told_apart(n):
    r = np.random.default_rng(n)
    ids, numbers = r.integers(-(2**63), 2**63 - 1, n), r.integers(0, 3, n)
    table = mph.build(ids, numbers)
    assert sorted(table.slots(ids, numbers)) == list(range(n)) and table.size == n
    again = mph.Levels(table.packed)
    assert (again.slots(ids, numbers) == table.slots(ids, numbers)).all()
    prints = np.empty(n, np.uint32)
    prints[table.slots(ids, numbers)] = mph.fingerprints(ids, numbers)
    strange = r.integers(-(2**63), 2**63 - 1, 2000)
    slot = table.slots(strange, np.full(2000, 9))
    assert not (prints[slot[slot >= 0]] == mph.fingerprints(strange, np.full(2000, 9))[slot >= 0]).any()


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        mph.build(np.array([3, 3]), np.array([0, 0]))


def test_blocks_are_whole_or_refused():
    data = tokenfiles.pack(np.dtype("<u2"), 3, 7, [5, None], [b"\x01\x00\x02\x00", b"\x02\x00"]) + tokenfiles.MAGIC_END.encode()
    task, number, nulls, ids, lengths, tokens = tokenfiles.unpack(memoryview(data))
    assert (task, number, nulls.tolist(), ids.tolist(), lengths.tolist(), tokens.tolist()) == (3, 7, [False, True], [5, 0], [2, 1], [1, 2, 2])
    for bad in (data[:-1], data[1:], b"", data[:-12] + data[-8:]):
        with pytest.raises(ValueError):
            tokenfiles.unpack(memoryview(bad))


def rows_of(found):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.collect()), key=lambda r: r[1])


def test_odd_rows_over_many_blocks(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(-(2**63), "low"), (2**63 - 1, "high"), (4, None)]
    rows += [(7, f"hot {i % 3}") for i in range(60)] + [(None, "nobody")] * 40 + [(None, f"n {i}") for i in range(20)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, copy string, start int")
    path = str(tmp_path / "files")
    found = tokenfiles.round_trip(docs, path, block=64, keys=16).collect()
    plain = expected(rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((k, n, c) for k, _, n, c in plain)
    found.sort(key=lambda r: r.start)
    at = 0
    for r, (key, _, _, _) in zip(found, plain, strict=True):
        assert (r.doc_id, r.start) == (key, at)
        at += r.n_tokens
    copies = Counter(r.doc_id for r in found)
    assert all(sorted(r.copy for r in found if r.doc_id == k) == list(range(n)) for k, n in copies.items())
    # Keyed access: any copy of a key, none of a stranger.
    place = {(r.doc_id, r.copy): r for r in found}
    keys = spark.createDataFrame([(7, 60), (7, 61), (7, 0), (None, 59), (None, 3), (999, 0), (13, 0), (13, 0)], "id bigint, copy bigint")
    got = {(r.id, r.copy): r.tokens for r in tokenfiles.fetch(spark, path, keys).collect()}
    assert set(got) == {(7, 60), (7, 0), (None, 59), (None, 3), (13, 0)}
    assert all(zlib.crc32(np.array(t, "<u4").tobytes()) == place[k].ids_crc32 for k, t in got.items())
    assert got[13, 0] == ids_of(ODD[13])
    assert tokenfiles.fetch(spark, path, keys.filter("id = 999").select("id")).count() == 0


def test_empty_table_and_other_vocabularies(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a  b"), (2, None)], "doc_id bigint, text string")
    empty = tokenfiles.round_trip(docs.limit(0), str(tmp_path / "none"))
    assert empty.columns == ["doc_id", "copy", "start", "n_tokens", "ids_crc32"] and empty.count() == 0
    path = tokenfiles.vocabulary_path("byte_bpe_50k.json")
    ids = [*Tokenizer.from_file(path).encode("a  b", add_special_tokens=False).ids, 70_000]
    found = rows_of(tokenfiles.round_trip(docs, str(tmp_path / "wide"), vocabulary=path, end_id=70_000))
    assert found[0] == (1, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and found[1][:3] == (2, len(ids), 1)


def test_whole_table_equals_whole_encodings(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = queries.op11_token_files(spark, SF_DIR)
    assert dict(found.dtypes)["start"] == dict(found.dtypes)["ids_crc32"] == "bigint"
    assert rows_of(found) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_an_index_of_other_files_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id bigint, text string")
    path = str(tmp_path / "files")
    tokenfiles.write_ids(docs, path)
    placed = tokenfiles.place_documents(tokenfiles.read_documents(spark, path), path)
    tokenfiles.write_index(placed.withColumn("offset", F.col("offset") + 1), path)
    located = tokenfiles.locate(spark, path, placed.select("id", "copy", "offset"))
    assert located.filter("at = offset + 1").count() == 40


class Plain:
    """An encoder whose ids are as many as the bytes of a text."""

    dtype = np.dtype("<u2")

    def tokens(self, column):
        size = [len(t) for t in column.to_pylist()]
        return np.ones(sum(size), self.dtype), np.cumsum([0, *size])


def peak_of(call):
    """(what the call returns, most bytes that Python and numpy held beside what was there before)"""
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_is_held_once_while_it_is_written():
    batch = pa.RecordBatch.from_arrays([pa.array(range(128), pa.int64()), pa.array(["x" * (1 << 16)] * 128)], ["id", "text"])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for n, found in enumerate(tokenfiles.packed_blocks(iter([batch]), Plain(), task=3, block=8 << 20)):
            held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
            assert found.num_rows == 1 and held < 1.5 * (8 << 20)
            task, number, nulls, ids, lengths, tokens = tokenfiles.unpack(memoryview(found.column(0)[0].as_py() + tokenfiles.MAGIC_END.encode()))
            assert (task, number, ids[0], set(lengths)) == (3, n, 63 * n, {(1 << 16) + 1}) and len(tokens) == sum(lengths)
            del nulls, ids, lengths, tokens
    finally:
        tracemalloc.stop()
    assert n == 2


def test_encoding_holds_a_small_part_of_the_texts():
    CODER.encode(["one two three"])
    text = "one two three " * 600_000  # 8 MB
    for column in (pa.array([text]), pa.array([text[:14_000]] * 600)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(column)), pa.int64()), column], ["id", "text"])
        found, most = peak_of(lambda: sum(b.nbytes for b in tokenfiles.packed_blocks(iter([batch]), CODER)))  # noqa: B023
        assert found > 3_600_000 and most < 24 << 20


def test_checksums_widen_a_document_at_a_time():
    tokens = np.arange(1 << 21).astype("<u2")
    lengths = np.full(1 << 11, 1 << 10)
    found, most = peak_of(lambda: tokenfiles.checksums(tokens, np.cumsum(lengths) - lengths, lengths))
    assert found == [zlib.crc32(tokens[i << 10 : (i + 1) << 10].astype("<u4").tobytes()) for i in range(1 << 11)] and most < 1 << 20


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["size", "n"])

    kept = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        docs = spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("word "), 20_000).alias("text"))
        found = small_batches(docs, 2000, tokenfiles.CARRIED).mapInArrow(sizes, "size bigint, n bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", kept)
    assert sum(r.n for r in found) == 100 and max(r.size for r in found) < tokenfiles.CARRIED + 200_000
