"""Name search, name formatting and JSON output as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: "Last, First", split at the last comma.
LAST_FIRST = r"^(.+),\s*(.+)$"


def legal_name(name: Column) -> Column:
    """'Last, First' as 'First Last'; NULL for a name without that form."""
    return F.when(
        name.rlike(LAST_FIRST),
        F.concat_ws(" ", F.regexp_extract(name, LAST_FIRST, 2), F.regexp_extract(name, LAST_FIRST, 1)),
    )


def search_consignors(consignors: DataFrame, text: str) -> DataFrame:
    """All digits: that consignor id (none has a number beyond bigint); otherwise a case-insensitive pattern on the name."""
    wanted = (
        F.col("ct_consign_id") == F.lit(text).try_cast("bigint") if text.isascii() and text.isdigit()
        else F.col("name").rlike("(?i)" + text)
    )
    return consignors.filter(wanted).select("ct_consign_id", "name", "customer_id", "vendor_id").orderBy("name")


def search_json(consignors: DataFrame, text: str) -> DataFrame:
    """Matches as one JSON object per row; double quotes are taken out of the name."""
    found = search_consignors(consignors, text)
    plain = F.regexp_replace("name", '"', "").alias("name")
    return found.select(
        "ct_consign_id", F.to_json(F.struct(F.col("ct_consign_id").cast("string").alias("ct_consign_id"), plain)).alias("json")
    )
