"""Token attribution against an independent tokenizer of the same vocabulary and a token-by-token count."""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfbook.llm import tokens

SF_DIR = "/root/testdata/sf0.001"
CONTENT = open(tokens.VOCABULARY, "rb").read()
OTHER = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
OTHER.encode_special_tokens = True
BYTES = {int(b): base64.b64decode(a) for a, b in map(bytes.split, CONTENT.splitlines())}


def by_hand(text, rule):
    """(start, end, tokens, crossing) of each section, in code points; tokens walked one by one."""
    ids = OTHER.encode(text, add_special_tokens=False).ids
    raw = text.encode()
    owner, k = [], 0
    for i, byte in enumerate(raw):
        owner.append(k)
        k += byte == 10 and i + 1 < len(raw)
    counts, crossing, at = Counter(), Counter(), 0
    for token in ids:
        held = owner[at : at + len(BYTES[token])]
        at += len(held)
        best = {"first": held[0], "last": held[-1], "most": Counter(held).most_common(1)[0][0]}[rule]
        counts[best] += 1
        crossing[best] += len(set(held)) > 1
    found, start = [], 0
    for k, line in enumerate(text.splitlines(keepends=True) if "\r" not in text else [text]):
        found.append((start, start + len(line), counts[k], crossing[k]))
        start += len(line)
    return found or [(0, 0, 0, 0)]


TEXTS = ["a b\n\n\nc d é\n", "\n\n\n", "", "no end", "日本\n語 <|endoftext|>\n  x", "x\n" * 50 + "\n" * 40 + "y"]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_equal_a_walk_over_the_tokens(spark, rule):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, section int")
    got = {}
    for r in tokens.count_by_section(docs, rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_tokens, r.n_crossing))
    assert got == {i: by_hand(t, rule) for i, t in enumerate(TEXTS)}


def test_whole_table_equals_the_walk(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {}
    for r in tokens.count_by_section(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.n_tokens, r.n_crossing))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i] == by_hand(text, "first")


@pytest.mark.parametrize("text", [" " * 5000, "a" + " " * 3000 + "b", "a" + "\n" * 3000 + "b", "x" + " " * 1500 + "\n" + "y" + " " * 2000])
def test_long_blanks_are_encoded_as_by_the_pattern(text):
    tokenizer, sizes = tokens.encoding(CONTENT, tokens.PATTERN)
    ids = tokens.encode(tokenizer, text)
    assert b"".join(BYTES[i] for i in ids) == text.encode()
    assert ids == tokenizer.encode_ordinary(text)
    assert sizes[ids].sum() == len(text)


def test_longest_blanks_and_words_do_not_fail(spark):
    texts = [" " * 300_000, "a" * 300_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = tokens.count_by_section(docs.union(docs.filter("doc_id = 2"))).orderBy("doc_id").collect()
    assert [r.end for r in got] == [300_000, 300_000, 0, 0]
    assert tokens.count_by_section(docs.limit(0)).count() == 0


def test_most_gives_ties_to_the_earlier_section():
    number, crosses = tokens.attribute(np.array([0, 4]), np.array([4, 7]), np.array([0, 2, 5]), "most")
    assert list(number) == [0, 2] and list(crosses) == [True, True]


def test_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError):
        tokens.count_by_section(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), rule="any")
