"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` how often each
query runs; the best run counts. Every result is produced in full and thrown away.
"""

from __future__ import annotations

import json
import os
import time

from shelfbook.plans import catalog, inputs
from shelfbook.session import local_session
from shelfbook.sources.files import write_ledger
from shelfbook.sources.shop import Shop, StoredLedgerShop

HEADLINES = [
    "post_invoices",
    "account_list",
    "payout_candidates",
    "sales_by_location",
    "payments_by_class",
    "till_running_balance",
    "misfiled_balances",
    "order_credit_position",
    "order_balance_due",
    "apply_order_discount",
    "merge_duplicate_payments",
    "open_checks",
    "convert_account_type",
    "next_ids",
]

# The same balances from a ledger that is already stored, as in daily use.
FROM_STORE = ["account_list", "payout_candidates", "misfiled_balances"]


def seconds(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, "bench")
    built = catalog.bound()
    times = {
        name: round(min(seconds(lambda: built[name](spark, sf_dir)) for _ in range(runs)), 3) for name in HEADLINES
    }
    derived = Shop(spark, sf_dir)
    stored = StoredLedgerShop(spark, sf_dir, inputs.scratch(derived))
    start = time.perf_counter()
    write_ledger(derived.postings, stored.ledger_path)
    times["write_ledger"] = round(time.perf_counter() - start, 3)
    for name in FROM_STORE:
        times[f"{name}_from_store"] = round(min(seconds(lambda: catalog.QUERIES[name](stored)) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
