"""Journal dimension upkeep (H-4, C-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOGUE_COLUMNS = ("name", "publisher", "feed_url", "enabled")
STATE_COLUMNS = ("etag", "last_modified", "last_checked_at", "last_success_at", "last_status", "last_error")


def upsert_catalogue(existing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """H-4: catalogue columns replaced for listed feeds, state columns kept; unlisted rows stay."""
    o = existing.alias("o")
    n = catalogue.alias("n")
    j = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    listed = F.col("n.id").isNotNull()
    cols = [F.coalesce(F.col("n.id"), F.col("o.id")).alias("id")]
    cols += [F.when(listed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in CATALOGUE_COLUMNS]
    cols += [(F.coalesce(F.col("o.last_status"), F.lit("never")) if c == "last_status" else F.col(f"o.{c}")).alias(c)
             for c in STATE_COLUMNS]
    return j.select(*cols)


def enabled_feeds(journals: DataFrame) -> DataFrame:
    """C-7."""
    return journals.where(F.col("enabled"))
