"""URL filter: host rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule names a host and a path prefix; it fits that host and its subdomains. The longest rule that fits
decides. Other URLs are judged by their words: terms are found in the URL with A-Z in lower case, as whole
words (no ASCII letter or digit on either side). Each term counts once, strict ones with the weight of a
rejection, soft ones with a part of it, so one strict or ``SOFT_NEEDED`` distinct soft terms reject.

The rules and the vocabulary are parameters of fixed size, sent with the tasks. A null URL, or one without
``://``, has an empty host and path and is judged by its words (a null has none: allow). Every row gives
a row. Columns other than the id and the URL are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
STRICT = ("porn", "xxx", "casino", "viagra", "escort", "hentai", "warez", "adult-x", "sex-chat", "payday-loans")
SOFT = (
    "adult", "ads", "bet", "bets", "cams", "cheap", "crack", "dating", "free", "gambling", "keygen", "loan", "lottery",
    "nude", "pills", "poker", "replica", "sexy", "slots", "spam", "torrent", "track", "tracker", "win",
)
SOFT_NEEDED = 2


@lru_cache
def automaton(strict: Sequence[str], soft: Sequence[str], needed: int) -> ahocorasick.Automaton:
    """Each term with its weight; a weight of ``needed`` rejects."""
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, 1))
    for term in strict:
        found.add_word(term, (term, needed))
    found.make_automaton()
    return found


def is_word(letter: str) -> bool:
    return letter.isascii() and letter.isalnum()


def weights(url: str, terms: ahocorasick.Automaton) -> int:
    """Sum of the weights of the distinct whole-word terms in a lower-cased URL."""
    hits = set()
    for last, (term, weight) in terms.iter(url):
        first = last + 1 - len(term)
        if not (first and is_word(url[first - 1])) and not (last + 1 < len(url) and is_word(url[last + 1])):
            hits.add((term, weight))
    return sum(weight for _, weight in hits)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?`` or ``#``; then the path up to ``?`` or ``#``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def judge(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    needed: int = SOFT_NEEDED,
) -> DataFrame:
    """(id column, host, path, rule, verdict, weight): ``weight`` is the vocabulary's, null where a rule decides."""
    strict, soft = tuple(strict), tuple(soft)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft, needed)
        for batch in batches:
            urls, verdicts = batch.column("url").to_pylist(), batch.column("verdict").to_pylist()
            found = [None if v else weights((u or "").encode().lower().decode(), terms) for u, v in zip(urls, verdicts, strict=True)]
            verdicts = [v or ("block" if w >= needed else "allow") for v, w in zip(verdicts, found, strict=True)]
            kept = [batch.column(c) for c in ("id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(verdicts, pa.string()), pa.array(found, pa.int64())],
                ["id", "host", "path", "rule", "verdict", "weight"],
            )

    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    plain = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).alias("url"))
    ruled = plain.select("id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict})
    shape = "id bigint, host string, path string, rule string, verdict string, weight bigint"
    return ruled.mapInArrow(count, shape).withColumnRenamed("id", id_column)


def judge_sql() -> str:
    """The same verdicts of ``pages`` as DuckDB SQL, from the same parameters."""
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1]))
    cases = [(fits.format(h=t.partition("/")[0], p=t.partition("/")[2]), a, t) for a, t in longest]
    rule = " ".join(f"WHEN {when} THEN '{text}'" for when, _, text in cases)
    ruled = " ".join(f"WHEN {when} THEN '{action}'" for when, action, _ in cases)
    term = "regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    score = " + ".join([f"{SOFT_NEEDED} * {term.format(t=t)}" for t in STRICT] + [term.format(t=t) for t in SOFT])
    return f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages
), parts AS (
  SELECT page_id, low, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM rest
), ruled AS (
  SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS decided, {score} AS score FROM parts
)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN decided IS NULL THEN score END::BIGINT AS weight
FROM ruled"""
