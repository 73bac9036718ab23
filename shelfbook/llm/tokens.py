"""Token counts by section: each document is encoded once, and its tokens are attributed by their offsets.

The tokenizer is a byte-pair vocabulary file of a public tokenizer; its path and pattern are parameters. The driver
reads the file (``MOST_BYTES`` at most) and hands its content to the tasks. A token's span follows from the
byte lengths of the tokens before it. Sections tile the text: each ends behind a line feed. Sorted token
starts are joined to sorted section bounds, and a token that crosses a bound goes, whole, by ``rule``: to the
section of its ``first`` byte, of its ``last``, or of ``most`` of its bytes (the earlier one of equals).
So the counts of a text's sections add up to the tokens of the text.

A null or empty text is one empty section without tokens. Every row gives its sections, repeated rows too.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed pattern of the vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_BYTES = 64 << 20
RULES = ("first", "last", "most")
# The library's pattern engine overflows on longer blanks; they are one pre-token, but for the last blank
# before a word. Four control characters are blanks to Python only.
LONG_BLANK = re.compile(r"[^\S\x1c-\x1f]{1000,}")


@lru_cache(maxsize=2)
def encoding(content: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a vocabulary file's content, and the byte length of each of its tokens."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(tokenizer: tiktoken.Encoding, text: str) -> list[int]:
    found, at = [], 0
    for blank in LONG_BLANK.finditer(text):
        end = blank.end() - (blank.end() < len(text))
        found += tokenizer.encode_ordinary(text[at : blank.start()])
        found += tokenizer._encode_single_piece(text[blank.start() : end])
        at = end
    return found + tokenizer.encode_ordinary(text[at:])


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section number of each token, and whether it crosses into another; ``bounds`` are the sections' starts."""
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "first":
        return first, first != last
    if rule == "last":
        return last, first != last
    best, most = first.copy(), np.zeros(len(first), np.int64)
    for step in range(int((last - first).max(initial=0)) + 1):
        at = np.minimum(first + step, last)
        end = np.append(bounds, np.iinfo(np.int64).max)[at + 1]
        held = np.minimum(ends, end) - np.maximum(starts, bounds[at])
        better = held > most
        best[better], most[better] = at[better], held[better]
    return best, first != last


def sections(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sections begin, and the text of each: at a text's start and behind a line feed that does not end it."""
    behind = np.flatnonzero(raw == 10) + 1
    behind = behind[~np.isin(behind, rows)]
    text = np.concatenate([np.arange(len(rows) - 1), np.searchsorted(rows, behind) - 1])
    order = np.argsort(text, kind="stable")
    return np.concatenate([rows[:-1], behind])[order], text[order]


def count_by_section(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rule: str = "first",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """(id column, section, start, end, n_tokens, n_crossing, doc_tokens) per section; offsets in code points.

    ``n_crossing`` counts the section's tokens that also reach into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as file:
        content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError("the vocabulary is too large to hand to every task")
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, sizes = encoding(shared.value, pattern)
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                raw, at = words.text_bytes(piece.column(1))
                ids = [encode(tokenizer, text) if text else [] for text in piece.column(1).to_pylist()]
                many = np.array([len(x) for x in ids])
                ends = np.cumsum(sizes[np.concatenate([np.array(x, np.int64) for x in ids])])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                bounds, doc = sections(raw, at)
                number, crosses = attribute(starts, ends, bounds, rule)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                end = np.append(bounds[1:], len(raw))
                first = np.searchsorted(doc, np.arange(piece.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(doc)),
                        pa.array(np.arange(len(doc)) - first[doc]),
                        pa.array(points[bounds] - points[at[doc]]),
                        pa.array(points[end] - points[at[doc]]),
                        pa.array(np.bincount(number, minlength=len(bounds))),
                        pa.array(np.bincount(number[crosses], minlength=len(bounds))),
                        pa.array(many[doc]),
                    ],
                    ["id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
                )

    shape = "id bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"
    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return small_batches(plain).mapInArrow(rows, shape).withColumnRenamed("id", id_column)
