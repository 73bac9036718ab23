from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from shelfbook.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    """The smallest data set, with the derived ledger kept between queries."""
    from shelfbook.sources.shop import Shop

    shop = Shop(spark, SF_DIR)
    for name in ("invoice_postings", "postings", "transactions"):
        shop.__dict__[name] = getattr(shop, name).persist()
    shop.postings_of = lambda *accounts: shop.postings.filter(shop.postings.account.isin(*accounts))
    return shop
