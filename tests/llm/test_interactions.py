"""The filter audit against every order run document by document."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfbook.llm import bits, interactions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def literal(rows, labels):
    """(part, order, step) to its counts, with each order applied to the documents that are left."""
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    docs = []
    for key, text, lang in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": text in first and (key is None or key > first[text]),
        }
        marks = [x for i, *x in labels if i is not None and i == key]
        docs.append((lang or "", {f for f, bad in fails.items() if bad}, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                gone += removed
                alone = sum(d[0] == part and d[1] == {f} for d in docs)
                out[part, order, step] = [len(left), len(removed), redundant, alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def prose(r, n):
    return " ".join("".join(r.choices("abcdeXé", k=r.randint(1, 7))) for _ in range(n))


def table_of(r):
    words = [prose(r, n) for n in (0, 1, 99, 100, 101, 150, 400)]
    texts = [None, "", " \n", *words, words[5] + " #", " ".join(["same"] * 120), "A" * 50, prose(r, 99) + " |", words[4].upper()]
    rows = [(i, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(150)]
    rows += [(None, texts[5], "en"), (None, texts[5], "en"), (None, "nobody has this " * 60, "en"), (None, "nobody has this " * 60, "de")]
    rows += [(7, texts[6], "en"), (7, texts[6], "en"), (-3, texts[6], "fr"), (2**62, texts[6], "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("most", [bits.MOST, 1 << 4])
def test_audit_equals_running_every_order(spark, monkeypatch, most):
    rows, labels = table_of(random.Random(most))
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id bigint, text string, lang string, mask int, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    if most < bits.LEAST:  # a sketch too small to clear any text changes nothing
        monkeypatch.setattr(bits, "size_for", lambda *_: 1 << 15)
        monkeypatch.setattr(interactions, "sketch", lambda *_: np.full(1 << 12, 255, np.uint8))
    found = interactions.audit(docs, marks)
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in found.collect()}
    assert found.columns[3:] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(found.dtypes)["step"] == "int" and {k for _, k in found.dtypes[3:]} == {"bigint"}
    assert got == literal(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "")], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interactions.audit(docs.limit(0), marks).count() == 0
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in interactions.audit(docs, marks).collect()}
    assert got == literal([(1, None, None), (2, "", "")], [])


def test_masks_of_long_texts_are_those_of_whole_texts(monkeypatch):
    r, plain = random.Random(3), interactions.words.stretches
    monkeypatch.setattr(interactions.words, "stretches", lambda raw: plain(raw, 50))
    for n in (99, 100, 3000):
        text = prose(r, n) + "\t\x0b " + "z" * 200
        w = WORD.findall(text)
        expected = (len(w) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        assert interactions.text_mask(text.encode()) == expected


def test_the_sketch_clears_unique_texts_and_no_copy(spark):
    texts = [f"text {i}" for i in range(3000)] + [f"text {i}" for i in range(0, 3000, 10)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    flags = interactions.text_flags(docs).cache()
    size = bits.size_for(len(texts), interactions.CELLS)
    met = interactions.sketch(flags, size)
    passed = [x.id for x in flags.filter(bits.all_set(met, F.col("hash"), spark)).select("id").collect()]
    copies = {i for i, t in enumerate(texts) if texts.count(t) > 1}
    assert copies <= set(passed) and len(passed) - len(copies) < 100
    counts = defaultdict(list)
    for i, t in enumerate(texts):
        counts[t].append(i)
    firsts = interactions.first_ids(docs, flags).collect()
    assert sorted(x.first for x in firsts) == sorted(min(v) for v in counts.values() if len(v) > 1)
