"""Importance resampling towards a target: documents are drawn by how much more their words are the target's than the corpus'.

Words come from a regular expression split of the ``tokenizers`` library (no vocabulary, nothing trained) over the text with A-Z
in lower case; it gives each word's byte offsets. Features are runs of 1 to ``longest`` words joined by a space: pairs
of offsets, one of a first and one of a last word, into the words written behind each other. A feature's bucket is its CRC-32 modulo
``buckets``. Two passes: the first cuts every text once, keeps each document's buckets with their counts, and adds up a
histogram of the corpus, summed in each task before it is shuffled; the target's texts give theirs alike. The driver
turns the two histograms, ``buckets`` rows each, into a gain per bucket, which goes to all tasks. The second pass sums
gains over the kept buckets. A document's score is its mean gain, floored, and Gumbel noise from a hash of its id, so
the highest scores are a draw without replacement; they are numbered in slices of the order, not in one task.

A null or wordless text has no feature, weight 0, and is never drawn while ``fewest`` is above 0. A null id is hashed as
an empty string and comes behind equal scores with an id. Repeated rows count, and may be drawn, each. Equal scores go by
id, then by fewer features. Columns other than the id and the text are ignored. Without documents there is no
row; without target texts every gain comes from the corpus alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from ..functions.keys import number_rows
from ..session import pin
from . import words
from .common import small_batches

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # letters and digits of ASCII, and whatever lies beyond it
LONGEST = 1  # words of a feature
BUCKETS = 10_000
MOST_BUCKETS = 1 << 22
FEWEST = 20  # words of a document that may be drawn
PERCENT = 10  # of these documents that are drawn
SEED = 2024
PIECE = 1 << 20  # bytes of a text that are split at once
_WORD_BYTES = 64  # words of more bytes are hashed one by one
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the table of the reflected polynomial of CRC-32
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice ``data[start:end]``."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    size = end - start
    order = np.argsort(-np.minimum(size, _WORD_BYTES + 1), kind="stable")
    long = int((size > _WORD_BYTES).sum())
    rest, at, many = order[long:], start[order[long:]], size[order[long:]]
    state = out[rest]
    live = len(rest)
    for i in range(int(many[0]) if live else 0):
        live = int(np.searchsorted(-many, -i, "left"))  # slices of more than i bytes come first
        state[:live] = _CRC[(state[:live] ^ data[at[:live] + i]) & 0xFF] ^ (state[:live] >> np.uint32(8))
    out[rest] = ~state
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


class Features:
    """Word offsets and feature buckets of texts, whole texts however long."""

    def __init__(self, longest: int, buckets: int, pattern: str = PATTERN):
        self.split = Split(Regex(pattern), "removed", invert=True)
        self.longest, self.buckets = longest, buckets

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Byte offsets (start, end) of the words of a text that is in lower case already."""
        cut = PreTokenizedString(text)
        self.split.pre_tokenize(cut)
        return [at for _, at, _ in cut.get_splits(offset_referential="original", offset_type="byte")]

    def of(self, raw: bytes) -> tuple[int, np.ndarray]:
        """Number of words of a text in UTF-8, and the bucket of each feature."""
        found, many, carried = [], 0, np.zeros(0, np.uint8)
        tail = np.zeros(0, np.int64)  # lengths of the last words of the stretch before
        for part in words.stretches(raw.lower(), PIECE):
            at = np.array(self.offsets(part.decode()), np.int64).reshape(-1, 2)
            if not len(at):
                continue
            many += len(at)
            size = np.concatenate([tail, at[:, 1] - at[:, 0]])
            end = np.cumsum(size + 1) - 1
            start = end - size
            # The words behind each other, a space between, so that a run of words is one slice.
            data = np.full(int(end[-1]) + 1, 32, np.uint8)
            data[: len(carried)] = carried
            own = at[:, 1] - at[:, 0]
            source = np.repeat(at[:, 0] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            data[np.repeat(start[len(tail) :] - (np.cumsum(own) - own), own) + np.arange(own.sum())] = np.frombuffer(part, np.uint8)[source]
            for run in range(1, self.longest + 1):
                first = np.arange(max(0, len(tail) - run + 1), len(size) - run + 1)
                if len(first):
                    found.append(crc32(data, start[first], end[first + run - 1]) % np.uint32(self.buckets))
            keep = min(self.longest - 1, len(size))
            tail = size[len(size) - keep :]
            carried = data[start[len(size) - keep] :] if keep else data[:0]
        return many, np.concatenate(found) if found else np.zeros(0, np.uint32)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``texts``, whose last column is ``text``, with words, features and the counts of their buckets in its place."""
    kept = texts.columns[:-1]
    names = [*kept, "n_words", "n_features", "bucket", "times"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(longest, buckets)
        for batch in batches:
            for piece in words.pieces(batch, "text"):
                raw, at = words.text_bytes(piece.column(len(kept)))
                many, of, held, times = [], [], [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n, found = features.of(raw[a:b].tobytes())
                    bucket, count = np.unique(found, return_counts=True)
                    many.append(n)
                    of.append(len(found))
                    held.append(bucket.astype(np.int32))
                    times.append(count)
                ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (held, times)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(many, pa.int64()), pa.array(of, pa.int64()), *lists], names)

    kinds = ("bigint", "bigint", "array<int>", "array<bigint>")
    shape = texts.select(*kept, *[F.lit(None).cast(kind).alias(n) for n, kind in zip(names[len(kept) :], kinds, strict=True)]).schema
    return small_batches(texts).mapInArrow(rows, shape)


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket: a row per task and bucket is shuffled, ``buckets`` rows come to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, times = (pa.concat_arrays([batch.column(i).flatten()]).to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(total, bucket, times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    by_task = counted.select("bucket", "times").mapInArrow(rows, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target and in the corpus, each with one feature more a bucket."""
    in_corpus, in_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    ratio = ((target + 1).astype(np.float64) * in_corpus) / ((corpus + 1).astype(np.float64) * in_target)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(id_column: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def scored(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(id, row, n_words, n_features, weight, score) per row; ``row`` tells rows of one id apart."""
    if not 1 <= buckets <= MOST_BUCKETS or longest < 1:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets, and features of one word at least")
    row = F.monotonically_increasing_id().alias("row")
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), row, F.col(text_column).alias("text"))
    counted = pin(bucket_counts(texts, longest, buckets))
    wanted = bucket_counts(target.select(F.col("text")), longest, buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(histogram(counted, buckets), histogram(wanted, buckets)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, times = batch.column("bucket"), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.diff(bucket.offsets.to_numpy()))])
            upto = np.concatenate([[0], np.cumsum(gain.value[bucket.flatten().to_numpy(zero_copy_only=False)] * times)])
            total, n = upto[ends[1:]] - upto[ends[:-1]], batch.column("n_features").to_numpy()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight)], names)

    names = ["id", "row", "n_words", "n_features", "weight"]
    weighed = counted.select(*names[:4], "bucket", "times").mapInArrow(rows, ", ".join(f"{n} bigint" for n in names))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def draw(scores: DataFrame, fewest: int = FEWEST, percent: int = PERCENT) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): the drawn rows are numbered from 1 in order, the others have no rank."""
    held = pin(scores)
    able = F.col("n_words") >= fewest
    many = percent * held.filter(able).count() // 100
    order = {"minus": -F.col("score"), "nameless": F.col("id").isNull()}
    ranked = number_rows(held.filter(able).withColumns(order), ["minus", "nameless", "id", "n_features", "row"], "at")
    kept = ["id", "n_words", "n_features", "weight", "score"]
    rank = F.when(F.col("at") <= many, F.col("at"))
    return ranked.select(*kept, rank.alias("rank")).union(held.filter(~able).select(*kept, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", fewest: int = FEWEST, percent: int = PERCENT, **options) -> DataFrame:
    """(id column, n_features, weight, score, rank, n_words) per row of ``docs``."""
    drawn = draw(scored(docs, target, id_column, **options), fewest, percent)
    return drawn.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank", "n_words")


def resample_sql() -> str:
    """The draw from ``documents`` towards ``benchmark`` as DuckDB SQL, one word a feature."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM (SELECT unnest(range(0, 256)) AS i))
), cut AS (
  SELECT 'd' AS part, doc_id, regexp_extract_all({lower}, '{PATTERN}') AS ws FROM documents
  UNION ALL SELECT 't', NULL, regexp_extract_all({lower}, '{PATTERN}') FROM benchmark
), numbered AS (
  SELECT *, row_number() OVER () AS n FROM cut
), tokens AS (
  SELECT part, n, unnest(ws) AS w FROM numbered
), vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM tokens)
), hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_transform(range(0, (length(h) // 2)::BIGINT), lambda k: ('0x' || substr(h, (2 * k + 1)::INT, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT)) % {BUCKETS} AS bucket
  FROM vocabulary, crc
), used AS (
  SELECT part, n, bucket FROM tokens JOIN hashed USING (w)
), histogram AS (
  SELECT b AS bucket, count(used.bucket) FILTER (part = 'd') AS s, count(used.bucket) FILTER (part = 't') AS t
  FROM (SELECT unnest(range(0, {BUCKETS})) AS b) LEFT JOIN used ON b = used.bucket GROUP BY b
), sums AS (
  SELECT sum(s)::DOUBLE + {BUCKETS} AS s, sum(t)::DOUBLE + {BUCKETS} AS t FROM histogram
), gains AS (
  SELECT bucket, floor(1000 * ln(((histogram.t + 1)::DOUBLE * sums.s) / ((histogram.s + 1)::DOUBLE * sums.t)))::BIGINT AS gain FROM histogram, sums
), weights AS (
  SELECT n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM used JOIN gains USING (bucket) WHERE part = 'd' GROUP BY n
), scores AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM numbered LEFT JOIN weights USING (n) WHERE part = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {FEWEST} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    {PERCENT} * count(*) FILTER (n_features >= {FEWEST}) OVER () // 100 AS many
  FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {FEWEST} AND place <= many THEN place END AS rank, n_features AS n_words FROM ranked"""
