"""Date normalisation (B-6): ISO 8601 or RFC 2822 text -> UTC TIMESTAMP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litfeed.constants import MAX_PUBLICATION_YEAR, MIN_PUBLICATION_YEAR

# --- fixed values: RFC 2822 layouts tried after the weekday is stripped ---
RFC2822_LAYOUTS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy HH:mm Z",
    "d MMM yyyy HH:mm z",
    "d MMM yyyy HH:mm",
)


def normalize_date(col: Column) -> Column:
    """Session time zone must be UTC (naive inputs are UTC).

    ISO forms go through ``try_cast`` (handles offsets, ``Z`` and date-only);
    RFC 2822 forms through ``try_to_timestamp`` with the weekday removed.
    """
    c = F.trim(col.cast("string"))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ][0-9:.]+)?(Z|[+-]\d{2}:?\d{2})?$"),
                 F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")))
    rfc_body = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
    rfc_body = F.regexp_replace(rfc_body, r"\s+(GMT|UT|UTC)$", " +0000")
    rfc = F.coalesce(*[F.try_to_timestamp(rfc_body, F.lit(fmt)) for fmt in RFC2822_LAYOUTS])
    ts = F.coalesce(iso, rfc)
    return F.when(F.year(ts).between(MIN_PUBLICATION_YEAR, MAX_PUBLICATION_YEAR), ts)


def iso_utc_text(col: Column) -> Column:
    """Fixed text form of a UTC timestamp, seconds precision."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
