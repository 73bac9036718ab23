"""Quality rules by host: failures are gathered per host, shrunk, and the host's verdict goes back to its rows.

Built-in functions only. Each row's counts are taken from its whole text and written once to the shared folder; hosts
are summed from them and joined back. A host's failure rate is drawn towards the rate of all rows by an
empirical beta prior: with intra-host correlation ``r`` (method of moments, 0 to 1) a host of ``n`` rows keeps
the share ``n r / (n r + 1 - r)`` of its own deviation. A host is rejected when its shrunk rate exceeds
``HOST_LIMIT``.

A null text has no words and fails. A null host is a host of its own. Repeated rows count each time and
stay. Columns other than the id, the host and the text are ignored. Windows of a text are told apart by a
64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import BLANK, WORD

WINDOW = 5
FEWEST_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
# Rules beside the base ones: symbols per word, repeated lines, letters per word.
SYMBOL_PERCENT, DUP_LINE_PERCENT, SHORTEST, LONGEST = 10, 30, 2, 12
HOST_LIMIT = 0.5


def window_hashes(words: str) -> Column:
    """Hashes of all windows of ``WINDOW`` words; ``words`` names an array column."""
    keys = ", ".join(f"get({words}, i + {k})" for k in range(WINDOW))
    return F.expr(f"if(size({words}) < {WINDOW}, array(), transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64({keys})))")


def repeat_words(hashes: str) -> Column:
    """Words in windows found twice or more. Windows are sorted only where some window is repeated.

    A flagged window that begins ``d`` words behind the flagged one before it adds min(WINDOW, d) words.
    """
    return F.expr(f"""
      if(size(array_distinct({hashes})) = size({hashes}), 0L, aggregate(
        sort_array(transform(
          flatten(transform(
            array(sort_array(transform({hashes}, (h, i) -> struct(h, i)))),
            s -> filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false))
          )),
          x -> x.i)),
        struct(cast(-{WINDOW} as int) as last, 0L as n),
        (a, p) -> struct(p as last, a.n + least({WINDOW}, p - a.last) as n),
        a -> a.n))""")


def counts(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text") -> DataFrame:
    """(id, host) and the counts of every row's whole text."""
    plain = docs.select(
        F.col(id_column).alias("id"), F.col(host_column).alias("host"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    cut = plain.select(
        "id", "host",
        F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words"),
        F.length(F.regexp_replace("text", f"[{BLANK}]+", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
    )
    hashed = cut.select(
        "id", "host", "word_chars", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        window_hashes("words").alias("hashes"),
    )
    return hashed.withColumn("n_repeat_words", repeat_words("hashes")).drop("hashes")


def failures(counted: DataFrame) -> DataFrame:
    """With ``base_failed`` and ``failed``, the latter by any rule."""
    words = F.col("n_words")
    base = (words < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * words)
    more = (
        (100 * F.col("n_symbols") > SYMBOL_PERCENT * words)
        | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < SHORTEST * words)
        | (F.col("word_chars") > LONGEST * words)
    )
    return counted.withColumns({"base_failed": base, "failed": base | more})


def host_rates(failed: DataFrame) -> DataFrame:
    """(host, rows, rate, shrunk) per host."""
    hosts = failed.groupBy("host").agg(F.count("*").alias("rows"), F.sum(F.col("failed").cast("bigint")).alias("bad"))
    n, p = F.col("rows").cast("double"), F.col("bad") / F.col("rows")
    whole = hosts.agg(
        F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"),
        (F.sum("bad") / F.sum(n)).alias("mean"), F.sum(n * p * p).alias("np2"),
    )
    # Between-host variance by moments, as a share r of the variance of a single row.
    single = F.col("mean") * (1 - F.col("mean"))
    spread = F.col("np2") - F.col("n") * F.col("mean") * F.col("mean") - (F.col("hosts") - 1) * single
    room = (F.col("n") - F.col("n2") / F.col("n")) * single
    share = F.when(room > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), spread / room))).otherwise(0.0)
    prior = whole.select(F.struct(F.col("mean"), share.alias("r")).alias("prior"))
    r, mean = F.col("prior.r"), F.col("prior.mean")
    weight = F.when(r > 0, n * r / (n * r + 1 - r)).otherwise(0.0)
    with_prior = hosts.withColumn("prior", prior.scalar())
    return with_prior.select("host", "rows", p.alias("rate"), (mean + (p - mean) * weight).alias("shrunk"))


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    host_column: str = "source",
    text_column: str = "text",
    host_limit: float = HOST_LIMIT,
) -> DataFrame:
    """One row per row: the id, the counts, ``base_failed``, ``failed``, the host's ``shrunk`` rate and ``kept``."""
    failed = pin(failures(counts(docs, id_column, host_column, text_column)))
    # Pinned, so that its true size is known and a small table is broadcast instead of shuffling all rows by host.
    rates = pin(host_rates(failed).select(F.col("host").alias("_host"), "shrunk"))
    judged = failed.join(rates, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("shrunk") <= host_limit))
    return judged.withColumnRenamed("id", id_column)


def judge_sql() -> str:
    """The verdicts of ``documents`` as DuckDB SQL."""
    leads = ", ".join(f"lead(w, {k}) OVER later" for k in range(1, WINDOW))
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM documents
), tokens AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts
), grams AS (
  SELECT doc_id, i, [w, {leads}] AS gram FROM tokens WINDOW later AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams WHERE gram[{WINDOW}] IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest(range(0, {WINDOW})) AS k FROM windows WHERE n > 1) GROUP BY doc_id
), counted AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id)
), base AS (
  SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM counted
), ruled AS (
  SELECT *, base_failed OR 100 * n_symbols > {SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines
    OR word_chars < {SHORTEST} * n_words OR word_chars > {LONGEST} * n_words AS failed FROM base
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(failed::INT) / count(*) AS p FROM ruled GROUP BY source
), whole AS (
  SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS n2, sum(n * p) / sum(n) AS mean, sum(n * p * p) AS np2 FROM hosts
), prior AS (
  SELECT mean, CASE WHEN (n - n2 / n) * mean * (1 - mean) > 0 THEN least(1.0, greatest(0.0,
    (np2 - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / ((n - n2 / n) * mean * (1 - mean)))) ELSE 0.0 END AS r
  FROM whole
), rates AS (
  SELECT source, mean + (p - mean) * (CASE WHEN r > 0 THEN n * r / (n * r + 1 - r) ELSE 0.0 END) AS shrunk FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND shrunk <= {HOST_LIMIT} AS kept
FROM ruled JOIN rates ON ruled.source IS NOT DISTINCT FROM rates.source"""
