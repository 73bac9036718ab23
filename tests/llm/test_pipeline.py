"""The pipeline's stages, each against a brute-force reading of its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from test_operators import SF_DIR, WORD, fingerprint, groups

from shelfbook.llm import bytenet


def test_every_stage_decides_as_its_rule_says(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, at, seen = docs.columns, docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF_DIR).persist()
        seen.append(at.collect())
    good, single, clean, mixed, placed = seen
    ids = lambda rows: Counter(r.doc_id for r in rows)

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    verdicts = {r.doc_id: r.predicted for r in bytenet.classify(docs, labels).collect()}
    assert ids(good) == Counter(i for i, keep in verdicts.items() if keep)

    named = groups([(r.doc_id, fingerprint(r.text)) for r in good])
    assert ids(single) == Counter(r.doc_id for r, c in zip(good, named, strict=True) if r.doc_id == c)

    cut = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    items = set().union(*[grams(cut(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    assert ids(clean) == Counter(r.doc_id for r in single if not grams(cut(r.text)) & items)

    size = {r.doc_id: len(WORD.findall(r.text)) for r in clean}
    assert set(ids(mixed)) <= set(ids(clean)) and max(ids(mixed).values()) <= 2
    whole, taken = sum(size.values()), sum(size[r.doc_id] for r in mixed)
    assert abs(taken - 1.5 * whole) <= 0.03 * whole
    assert ids(placed) == ids(mixed) and len({(r.doc_id, r.shard) for r in placed}) == len(ids(placed))
    assert all(list(r[0].__fields__) == columns for r in seen[:-1])
    assert ids(corpus_pipeline.run(spark, SF_DIR).collect()) == ids(placed)
