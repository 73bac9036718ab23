"""WARC archives of pages, and an index of their captures in global order by an external merge.

Writing: every page is a record with its HTTP head, the payload in UTF-8 behind it unless an equal payload of at
least ``LEAST`` bytes is already stored as a response; those are ``revisit`` records that name it. Records of
equal payloads meet at their digest through one aggregated row, so a payload that many pages share is no hot
group. Files are written by Spark's text writer, whose line end is the record end, gzipped, with at most
``RECORDS`` records each; they reach any store that Spark reaches.

Reading: each archive file is unzipped piece by piece and parsed by the lengths in its heads, so that a record and no more
is in memory beside the zipped file, payload digests are checked, and its captures, sorted by URL key and time, form a run. Runs are dealt to ranges of the key, and each range merges its runs by
a loser tree, which replays one path of comparisons per capture. Ranges hold about ``RANGE`` captures, so the
merge needs bounded memory, and one URL with very many captures is cut into several ranges.

A null payload is empty, a null URL gives an empty target. Rows of one id each give a record; the smallest id
of a payload is its response, and where rows repeat that id each is a response. A null id is never
anyone's response and has none: it stays a response itself. Columns other than the id, URL and
payload are ignored, ``captured`` (a timestamp) is used if named; else the time follows from the id, whatever its size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin, scratch_folder

LEAST = 100  # bytes of a payload that others may revisit
RECORDS = 2000  # of a file
RANGE = 50_000  # captures that one merge task takes
END = "\r\n\r\n"  # of a head, and of a record
EPOCH = "2024-01-01T00:00:00Z"
SPAN = 1 << 31  # seconds behind EPOCH among which times are derived from ids
PIECE = 1 << 20  # bytes that are unzipped at once
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, archive string, place int"
)


def with_types(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", captured: str | None = None) -> DataFrame:
    """(page_id, url, payload, captured, bytes, digest, first): ``first`` is the response that a revisit refers to."""
    derived = F.pmod(F.coalesce(F.col(id_column).cast("bigint"), F.lit(0)), F.lit(SPAN))
    when = F.col(captured) if captured else F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + derived)
    plain = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.coalesce(url_column, F.lit("")).alias("url"),
        F.coalesce(payload_column, F.lit("")).alias("payload"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    ).withColumns({"bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    long = plain.filter((F.col("bytes") >= LEAST) & F.col("page_id").isNotNull())
    shared = long.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    first = F.when((F.col("_first") != F.col("page_id")) & (F.col("bytes") >= LEAST), F.col("_first"))
    return plain.join(shared, "digest", "left").withColumn("first", first).drop("_first")


def record(typed: DataFrame) -> Column:
    """A whole WARC record but for its end, which the writer adds. Line ends in a URL would end its field and are escaped."""
    line = lambda name, *value: F.concat(F.lit(f"\r\n{name}: "), *value)
    revisit = F.col("first").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.lit("<urn:page:"), page, F.lit(">")),
        line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(END), body,
    )


def write_archives(pages: DataFrame, path: str, **columns: str | None) -> None:
    """Write every page as a record into gzipped archives under ``path``."""
    typed = with_types(pages, **columns)
    text = typed.select(record(typed).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels turned round, then the rest; no scheme, no leading www, lower case."""
    rest = url.partition("://")[2] or url
    host, path = re.match(r"([^/?#]*)([^#]*)", rest).groups()
    labels = host.lower().removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}){(path or '/').lower()}"


def unzipped(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces of at most ``PIECE`` bytes."""
    while data:
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            piece = member.decompress(data, PIECE)
            if not piece and not member.unconsumed_tail and not member.eof:
                raise ValueError("an archive is cut short")
            data = member.unconsumed_tail
            yield piece
        data = member.unused_data


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, block) of every record of an archive, whatever its blocks hold; one record at a time is in memory."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size and (piece := next(pieces, None)) is not None:
            held.extend(piece)
        return len(held) >= size

    while fill(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            known = len(held)
            if not fill(known + 1):
                raise ValueError("a record is cut short")
            end = held.find(b"\r\n\r\n", max(0, known - 3))
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        head = dict(line.split(": ", 1) for line in lines)
        last = end + 4 + int(head["Content-Length"])
        if not fill(last + 4) or held[last : last + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        block = bytes(held[end + 4 : last])
        del held[: last + 4]
        yield head, block


def capture(head: dict[str, str], block: bytes) -> tuple:
    """(URL key, time, id, payload's bytes and digest, type, reference) of a record, its payload checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what was stored")
    number = lambda field: int(m[0]) if (m := re.search(r"-?\d+", head.get(field, ""))) else None
    page, refers = number("WARC-Record-ID"), number("WARC-Refers-To")
    return url_key(head["WARC-Target-URI"]), head["WARC-Date"], page, size, digest, kind, refers


def sort_key(row: tuple) -> tuple:
    """URL key in order of its bytes, time, id with nulls first, archive, place."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every archive file under ``path``, each file's in order; ``place`` numbers them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                name = archive.as_py().rpartition("/")[2]
                found = [(*capture(*r), name, i) for i, r in enumerate(records(unzipped(content.as_buffer().to_pybytes())))]
                found.sort(key=sort_key)
                yield _batch([(*row[:8], i) for i, row in enumerate(found)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return pin(files.mapInArrow(rows, CAPTURE))


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32()]
_NAMES = [field.split()[0] for field in CAPTURE.split(", ")]


def _batch(found: list[tuple], names: list[str] = _NAMES, types: list[pa.DataType] = _TYPES) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def merge(sorted_runs: list[list[tuple]]) -> Iterator[tuple]:
    """All rows of sorted runs in order, by a loser tree: each inner node holds the run that lost there.

    The winner's next row replays the nodes from its leaf to the root, one comparison each.
    """
    k = len(sorted_runs)
    streams = [iter(run) for run in sorted_runs]
    heads = [next(s, None) for s in streams]
    keys = [(h is None, sort_key(h) if h else ()) for h in heads]
    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not None:
        yield heads[best]
        heads[best] = next(streams[best], None)
        keys[best] = (heads[best] is None, sort_key(heads[best]) if heads[best] else ())
        node = (k + best) // 2
        while node:
            if keys[losers[node]] < keys[best]:
                best, losers[node] = losers[node], best
            node //= 2


def histories(captures: DataFrame, rows_of_range: int = RANGE) -> DataFrame:
    """Captures in global order of URL key and time: ordered within each partition, and partition after partition."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                by_run.setdefault(row[7], []).append(row)
        for run in by_run.values():  # a shuffle keeps no order between its blocks: put each run's stretches in place
            run.sort(key=lambda row: row[8])
        out: list[tuple] = []
        for row in merge(list(by_run.values())):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    ranges = max(1, -(-captures.count() // rows_of_range))
    dealt = captures.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "place")
    return dealt.mapInArrow(merged, CAPTURE)


def round_trip(pages: DataFrame, path: str | None = None, **columns: str | None) -> DataFrame:
    """Write the pages as archives, read these back, and return their captures in global order."""
    spark = pages.sparkSession
    path = path or scratch_folder(spark)
    write_archives(pages, path, **columns)
    return histories(runs(spark, path))


def round_trip_sql() -> str:
    """The captures of ``pages`` as DuckDB SQL."""
    rest = "CASE WHEN contains(coalesce(url, ''), '://') AND split_part(url, '://', 2) <> '' THEN substr(url, instr(url, '://') + 3) ELSE coalesce(url, '') END"
    return f"""
WITH plain AS (
  SELECT page_id, coalesce(html, '') AS payload, {rest} AS rest,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM pages
), sized AS (
  SELECT *, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
    regexp_replace(lower(regexp_extract(rest, '^[^/?#]*')), '^www[.]', '') AS host,
    lower(regexp_extract(rest, '^[^/?#]*([^#]*)', 1)) AS path
  FROM plain
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= {LEAST} GROUP BY payload_digest
), typed AS (
  SELECT sized.*, CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN first END AS refers_to
  FROM sized LEFT JOIN firsts USING (payload_digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  refers_to, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key,
  captured
FROM typed"""
