"""Words and word hashes of Arrow text columns, by whole arrays instead of by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
# The five primes of XXH64: fixed values of the hash's definition.
P1, P2, P3, P4, P5 = (
    U64(0x9E3779B185EBCA87),
    U64(0xC2B2AE3D27D4EB4F),
    U64(0x165667B19E3779F9),
    U64(0x85EBCA77C2B2AE63),
    U64(0x27D4EB2F165667C5),
)
PADDING = 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# All of ASCII but letters and digits.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row begins; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``size`` bytes of text; a longer text stays whole in its own slice."""
    ends = text_bytes(batch.column(batch.schema.get_field_index(column)))[1][1:]
    first = 0
    while first < batch.num_rows:
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + size, "right")))
        yield batch.slice(first, last - first)
        first = last


def stretches(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end behind a space or line feed, in whole where it has neither."""
    first = 0
    while len(raw) - first > size:
        last = max(raw.rfind(b, first + 1, first + size) for b in (b" ", b"\n"))
        if last < 0:
            last = min((x for b in (b" ", b"\n") if (x := raw.find(b, first + size)) >= 0), default=len(raw) - 1)
        yield raw[first : last + 1]
        first = last + 1
    yield raw[first:]


@dataclass
class Words:
    """Words of several texts: each text's words joined by single spaces, in one byte array."""

    data: np.ndarray  # lower-cased bytes, padded for eight-byte reads
    start: np.ndarray  # of each word in ``data``
    end: np.ndarray
    first: np.ndarray  # number of each text's first word, and of all words


def split_words(raw: np.ndarray, rows: np.ndarray, blank: np.ndarray = BLANK) -> Words:
    """Words of the texts that begin at ``rows`` in ``raw``, with A-Z in lower case; ``blank`` marks the bytes between."""
    word = ~blank[raw]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = rows[(rows > 0) & (rows < len(raw))]
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    length = stop - start
    end = np.cumsum(length + 1) - 1
    data = np.full(int(length.sum()) + len(length) + PADDING, 32, np.uint8)
    letters = _LOWER[raw[word]]
    data[np.arange(len(letters)) + np.repeat(np.arange(len(length)), length)] = letters
    return Words(data, end - length, end, np.searchsorted(start, rows))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each slice ``data[start:end]``; ``data`` has ``PADDING`` bytes behind the last slice."""
    data = np.ascontiguousarray(data)
    eights = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    fours = np.ndarray(max(0, len(data) - 3), "<u4", data, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        h = size.astype(U64) + (U64(seed) + P5)
        for lane in range(3):
            at = np.flatnonzero(size >= 8 * (lane + 1))
            k = _turn(eights[start[at] + 8 * lane] * P2, 31) * P1
            h[at] = _turn(h[at] ^ k, 27) * P1 + P4
        rest, left = start + (size & ~7), size & 7
        at = np.flatnonzero(left >= 4)
        h[at] = _turn(h[at] ^ (fours[rest[at]].astype(U64) * P1), 23) * P2 + P3
        rest, left = rest + (left & 4), left & 3
        for i in range(3):
            at = np.flatnonzero(left > i)
            h[at] = _turn(h[at] ^ (data[rest[at] + i].astype(U64) * P5), 11) * P1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        h ^= h >> U64(32)
    for i in np.flatnonzero(size >= 32):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return h


def shingles(found: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of ``size`` words, and how many each text has; a text of fewer words is one shingle."""
    many = np.diff(found.first)
    count = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    head = np.repeat(found.first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    tail = head + np.repeat(np.minimum(many, size) - 1, count)
    return xxh64(found.data, found.start[head], found.end[tail], seed), count
