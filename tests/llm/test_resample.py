"""The draw towards a target against a literal reading of its rule."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfbook.llm import resample, words

CUT = re.compile(resample.PATTERN)


def features_of(text, longest):
    w = CUT.findall((text or "").encode().lower().decode())
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def literal(rows, target, longest=1, buckets=resample.BUCKETS, fewest=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank, n_words) of every row."""
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for x in texts for f in features_of(x, longest)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for key, text in rows:
        n, found = features_of(text, longest)
        weight = sum(gain(at(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= fewest), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return Counter(map(tuple, out))


def test_crc_equals_the_library():
    data = np.frombuffer(np.random.default_rng(1).bytes(5000), np.uint8)
    start = np.arange(0, 4800, 3)
    end = start + np.arange(len(start)) % 150
    assert resample.crc32(data, start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end, strict=True)]
    assert len(resample.crc32(data, start[:0], end[:0])) == 0


ODD = ["", " ", "One", "a B  c", "x\x00y\x7fz", "é-É ſ K", "日本 語" * 3, "q" * 200 + " " + "é" * 100, "a_b 1.5 \n\n\t ok", "  lead", "tail  "]


@pytest.mark.parametrize("piece", [1 << 20, 7])
@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_of_whole_texts(monkeypatch, piece, longest):
    monkeypatch.setattr(resample, "PIECE", piece)
    cut = resample.Features(longest, 997)
    r = random.Random(0)
    for text in [*ODD, *(" ".join(r.choices(ODD + ["w", "Two"], k=12)) for _ in range(30))]:
        n, found = cut.of(text.encode())
        many, plain = features_of(text, longest)
        assert n == many and Counter(found.tolist()) == Counter(zlib.crc32(f.encode()) % 997 for f in plain), text
        assert b"".join(words.stretches(text.encode(), piece)) == text.encode()


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 50)])
def test_draw_equals_the_rule(spark, longest, buckets):
    r = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本"]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    same = prose(40)
    rows = [(i, prose(r.choice([0, 1, 19, 20, 21, 80]))) for i in range(200)] + [(i, t) for i, t in enumerate(ODD)]
    rows += [(None, same)] * 30 + [(5, same)] * 30 + [(None, None), (3, None), (-7, prose(30)), (2**62, prose(30))]
    target = [prose(30), None, "", same, "w1 w1 w1"]
    docs = spark.createDataFrame([(*x, 0, "z") for x in rows], "doc_id bigint, text string, rank int, n_words string").repartition(5)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = resample.resample(docs, wanted, longest=longest, buckets=buckets, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert all(kind == "bigint" for _, kind in got.dtypes)
    assert Counter(map(tuple, got.collect())) == literal(rows, target, longest, buckets, percent=30)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, "c d " * 20), (3, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert resample.resample(docs.limit(0), none).count() == 0
    got = resample.resample(docs, none, percent=50).collect()
    assert Counter(map(tuple, got)) == literal([(1, "a b " * 20), (2, "c d " * 20), (3, None)], [], percent=50)
    with pytest.raises(ValueError):
        resample.resample(docs, none, buckets=0)
