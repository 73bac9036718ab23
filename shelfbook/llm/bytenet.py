"""Quality classifier: a small convolutional network over the bytes of the whole text, in numpy.

Bytes are embedded, learned filters slide over them, each overlapping chunk keeps every filter's maximum,
and a document's chunks are combined by their mean and their maximum into one probability. Every byte of a
text is read, however long the text.

It is fitted on a bounded sample: at most ``SAMPLE`` labelled documents, picked by a hash of the id among
those whose text has at most ``SAMPLE_BYTES`` bytes. Fitting is deterministic. A document of several rows
counts once in the sample. Scores take nothing but the text. A null or empty text is scored as one of no
bytes. With no usable label the score is 0.5 for all. Every row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fresh, small_batches

SAMPLE = 3000
SAMPLE_BYTES = 1 << 15
FOLDS = 5
THRESHOLD = 0.3
KERNEL, STRIDE = 8, 4  # bytes that a filter sees, and bytes from one place to the next
CHUNK, OVERLAP = 1024, 64  # bytes
EMBEDDING, FILTERS = 6, 24
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
NO_BYTE = 256  # behind the end of a text


@dataclass
class Net:
    embed: np.ndarray  # (257, EMBEDDING)
    filters: np.ndarray  # (KERNEL * EMBEDDING, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS,): means, then maxima
    level: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.level]


def new_net(seed: int = 7) -> Net:
    r = np.random.default_rng(seed)
    draw = lambda *shape: r.normal(0, 1, shape).astype(np.float32)
    return Net(
        0.5 * draw(257, EMBEDDING), draw(KERNEL * EMBEDDING, FILTERS) * (KERNEL * EMBEDDING) ** -0.5,
        np.zeros(FILTERS, np.float32), 0.1 * draw(2 * FILTERS), np.zeros(1, np.float32),
    )


@dataclass
class Layout:
    """Texts one after another, each padded, with their places (where filters apply) and chunks."""

    symbols: np.ndarray
    chunk_first: np.ndarray  # first place of each chunk
    chunk_end: np.ndarray
    doc_chunk: np.ndarray  # first chunk of each text


def lay_out(raw: np.ndarray, rows: np.ndarray) -> Layout:
    size = np.diff(rows)
    steps = np.maximum(-(-size // STRIDE), 1)  # places of each text: one per stride, at least one
    begin = np.cumsum(steps + KERNEL // STRIDE - 1) - (steps + KERNEL // STRIDE - 1)
    symbols = np.full(int((steps + KERNEL // STRIDE - 1).sum()) * STRIDE, NO_BYTE, np.uint16)
    symbols[np.arange(len(raw)) + np.repeat(STRIDE * begin - rows[:-1], size)] = raw
    hop, reach = (CHUNK - OVERLAP) // STRIDE, CHUNK // STRIDE
    chunks = np.maximum(-(-(steps - (reach - hop)) // hop), 1)
    number = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = np.repeat(begin, chunks) + hop * number
    end = np.minimum(first + reach, np.repeat(begin + steps, chunks))
    return Layout(symbols, first, end, np.cumsum(chunks) - chunks)


def strides(net: Net, symbols: np.ndarray) -> list[np.ndarray]:
    """The embedded bytes that each place's filters see, a stride at a time."""
    flat = np.take(net.embed, symbols, axis=0).reshape(-1, STRIDE * EMBEDDING)
    return [flat[i : len(flat) - KERNEL // STRIDE + 1 + i] for i in range(KERNEL // STRIDE)]


def responses(net: Net, symbols: np.ndarray) -> np.ndarray:
    """Every filter at every place."""
    width = STRIDE * EMBEDDING
    return sum(x @ net.filters[i * width : (i + 1) * width] for i, x in enumerate(strides(net, symbols)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(net: Net, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    lay = lay_out(raw, rows)
    at = responses(net, lay.symbols)
    at = np.concatenate([at, at[-1:]])  # so that a chunk may end behind the last place
    pairs = np.stack([lay.chunk_first, lay.chunk_end], 1).ravel()
    tops = np.maximum(np.maximum.reduceat(at, pairs, axis=0)[::2] + net.bias, 0)
    return sigmoid(combined(tops, lay.doc_chunk) @ net.out + net.level[0]).astype(np.float64)


def combined(tops: np.ndarray, doc_chunk: np.ndarray) -> np.ndarray:
    many = np.diff(np.append(doc_chunk, len(tops)))[:, None]
    mean = np.add.reduceat(tops, doc_chunk, axis=0) / many
    return np.concatenate([mean, np.maximum.reduceat(tops, doc_chunk, axis=0)], axis=1)


def gradients(net: Net, raw: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy by each part of the net. Only places that are a chunk's maximum carry any."""
    lay = lay_out(raw, rows)
    seen = np.concatenate(strides(net, lay.symbols), axis=1)
    at = seen @ net.filters
    best = np.stack([a + at[a:b].argmax(0) for a, b in zip(lay.chunk_first, lay.chunk_end, strict=True)])
    tops = np.maximum(np.take_along_axis(at, best, 0) + net.bias, 0)
    found = combined(tops, lay.doc_chunk)
    error = (sigmoid(found @ net.out + net.level[0]) - labels) / len(labels)
    by_found = error[:, None] * net.out
    many = np.diff(np.append(lay.doc_chunk, len(tops)))
    doc = np.repeat(np.arange(len(many)), many)
    by_top = by_found[doc, :FILTERS] / many[doc, None]
    is_top = tops == found[doc, FILTERS:]
    share = is_top / np.add.reduceat(is_top.astype(np.float32), lay.doc_chunk, axis=0)[doc]
    by_top = (by_top + by_found[doc, FILTERS:] * share) * (tops > 0)
    by_filters = np.einsum("cfk,cf->kf", seen[best], by_top)
    by_window = np.einsum("cf,kf->cfk", by_top, net.filters).reshape(-1, EMBEDDING)
    bytes_seen = lay.symbols[(best[..., None] * STRIDE + np.arange(KERNEL)).ravel()]
    by_embed = np.stack([np.bincount(bytes_seen, by_window[:, i], 257) for i in range(EMBEDDING)], 1)
    return [by_embed, by_filters, by_top.sum(0), found.T @ error, error.sum(keepdims=True)]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam over shuffled batches; the level starts at the labels' own rate."""
    net, r = new_net(seed), np.random.default_rng(seed)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    net.level[0] = np.log(rate / (1 - rate))
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    steps = epochs * -(-len(texts) // BATCH)
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            picked = order[i : i + BATCH]
            raw = np.frombuffer(b"".join(texts[j] for j in picked), np.uint8)
            rows = np.cumsum([0, *[len(texts[j]) for j in picked]])
            step += 1
            pace = RATE * (1 - step / (steps + 1))
            for p, m, v, g in zip(net.parts(), first, second, gradients(net, raw, rows, labels[picked]), strict=True):
                g = g.astype(np.float32) + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def is_held_out(id_column: Column | str) -> Column:
    """A fifth of all ids, never learned from."""
    return F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column.cast("string")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """At most ``size`` labelled documents outside the held-out fold, in a fixed order."""
    marked = (
        labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("double").alias("label"))
        .filter("id is not null and label in (0, 1)").filter(~is_held_out("id"))
        .groupBy("id").agg(F.min("label").alias("label"))
    )
    count = marked.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * size / max(count, 1)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") <= SAMPLE_BYTES)
    picked = marked.filter(share if count > size else F.lit(True))
    rows = picked.join(texts, "id").groupBy("id", "label").agg(F.min("text").alias("text")).limit(size).collect()
    rows.sort(key=lambda r: r.id)
    return [r.text.encode() for r in rows], np.array([r.label for r in rows], np.float32)


def score_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    threshold: float = THRESHOLD,
    into: tuple[str, str] = ("_score", "_predicted"),
) -> DataFrame:
    """The rows of ``docs`` with two columns more: the probability of label 1, and 1 from the threshold on."""
    texts, marks = sample(docs, labels, label)
    net = fit(texts, marks) if len(texts) else None
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch, "text", 1 << 18):
                p = score(net, *words.text_bytes(piece.column(at))) if net else np.full(piece.num_rows, 0.5)
                columns = [*piece.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names, *into])

    shape = docs.select("*", F.lit(0.0).alias(into[0]), F.lit(0).alias(into[1])).schema
    return small_batches(docs).mapInArrow(rows, shape)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    scored = score_rows(docs.select("doc_id", "text"), labels)
    held = F.coalesce(is_held_out("doc_id"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    into = tuple(fresh(docs.columns, "_score", "_predicted"))
    return score_rows(docs, labels, into=into).filter(F.col(into[1]) == 1).select(*docs.columns)
