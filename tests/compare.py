"""Compare catalog queries with their SQL statements: columns, types and values, in any row order."""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain_type(name: str) -> str:
    """Spark and DuckDB type names in one spelling."""
    name = name.lower()
    same = {"long": "bigint", "integer": "int", "int64": "bigint", "varchar": "string", "timestamp_ntz": "timestamp"}
    return same.get(name, name)


def cell(value):
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def differences(spark_df, con, sql: str) -> list[str]:
    """What does not match; empty when all is well."""
    result = con.execute(sql)
    theirs = {d[0]: plain_type(str(d[1])) for d in result.description}
    ours = {f.name: plain_type(f.dataType.simpleString()) for f in spark_df.schema.fields}
    problems = []
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} against {sorted(theirs)}"]
    problems += [f"type of {c}: {ours[c]} against {theirs[c]}" for c in ours if ours[c] != theirs[c]]
    order = sorted(ours)
    at = [list(theirs).index(c) for c in order]
    expected = Counter(tuple(cell(row[i]) for i in at) for row in result.fetchall())
    got = Counter(tuple(cell(v) for v in row) for row in spark_df.select(*order).collect())
    if got != expected:
        extra, missing = got - expected, expected - got
        problems.append(f"{sum(got.values())} rows against {sum(expected.values())}; {sum(extra.values())} differ")
        problems += [f"only Spark: {dict(zip(order, r))}" for r in list(extra)[:3]]
        problems += [f"only SQL: {dict(zip(order, r))}" for r in list(missing)[:3]]
    return problems


def keep_ledger(spark, sf_dir: str):
    """The queries over one shop whose derived ledger is kept in memory; quicker for many queries."""
    from shelfbook.plans.catalog import QUERIES
    from shelfbook.sources.shop import Shop

    shop = Shop(spark, sf_dir)
    for name in ("invoice_postings", "postings", "transactions"):
        shop.__dict__[name] = getattr(shop, name).persist()
    shop.postings_of = lambda *accounts: shop.postings.filter(shop.postings.account.isin(*accounts))
    return {name: lambda _spark, _dir, build=build: build(shop) for name, build in QUERIES.items()}


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as contract
    from shelfbook.session import local_session

    spark, con = local_session(8), connect(sf_dir)
    built, sql = contract.queries(), contract.oracle_sql()
    if "--keep-ledger" in names:
        names = [n for n in names if n != "--keep-ledger"]
        built = keep_ledger(spark, sf_dir)
    bad = 0
    for name in names or built:
        start = time.time()
        try:
            problems = differences(built[name](spark, sf_dir), con, sql[name]) if name in sql else ["no statement"]
        except Exception as error:  # report and go on with the next query
            problems = [str(error)[:500]]
        bad += bool(problems)
        print("ok  " if not problems else "BAD ", name, round(time.time() - start, 1), *problems, sep="  ", flush=True)
    print(f"{bad} of {len(names or built)} differ")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
