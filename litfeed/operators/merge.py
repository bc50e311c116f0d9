"""Field-level merge as an associative aggregate (E-10, E-11, B-18, H-5).

Sequential rule per field (survivor state, absorbed rows, incoming items):
the last enriched value wins; else the last known value; else the first
value of the surviving row. Absorbed rows rank below the survivor's own
items and among themselves by the time they were absorbed, which ``phase``
encodes. With key = (phase, seq):

    v* = coalesce(max_by(v, key) FILTER enr, max_by(v, key) FILTER known,
                  min_by(v, seq) FILTER phase = 0)
    enr* = bool_or(enr)

The three terms are one ``max_by`` over (tier, key): an item stands in the
highest tier it reaches, and the last term counts only if no item is known.
Every term is a partial aggregate, so Spark combines map-side before the
shuffle by entity, with one value a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litfeed.constants import ENRICHABLE_FIELD_ORDER
from litfeed.functions.articles import KNOWN, rank_status, status_rank

MERGED_FIELDS = ("title", "abstract", "published_at", "article_type", "oa_status")


def _field_aggs(f: str, enr: Column, real: Column) -> list[Column]:
    v = F.col(f)
    known = KNOWN[f](v) & real
    e = enr & known
    key = lambda tier, phase, seq: F.struct(F.lit(tier).alias("tier"), phase.alias("phase"), seq.alias("seq"))
    phase, seq = F.col("phase"), F.col("seq")
    own = (phase == 0) & real & seq.isNotNull()
    rank = F.when(e, key(2, phase, seq)).when(known, key(1, phase, seq)).when(own, key(0, phase, -seq))
    return [F.max_by(F.struct(v.alias("v")), rank)["v"].alias(f), F.bool_or(e).alias(f"{f}_enriched")]


def merge(resolved: DataFrame, fields=MERGED_FIELDS, enriched_col: str = "enriched") -> DataFrame:
    """One row per entity from resolved items (``entity, uid, phase, seq`` + fields).

    Optional columns: ``<field>_enr`` (per-field provenance flag, else
    ``enriched_col`` applies to every field) and ``is_alias`` (pseudo-items that
    only carry a URL -> DOI link; they take part in identity, not in values).
    """
    cols = set(resolved.columns)
    real = ~F.coalesce(F.col("is_alias"), F.lit(False)) if "is_alias" in cols else F.lit(True)
    aggs = [F.max("uid").alias("uid"), F.max("doi").alias("doi")]
    for f in fields:
        enr = F.coalesce(F.col(f"{f}_enr") if f"{f}_enr" in cols else F.col(enriched_col), F.lit(False))
        aggs += _field_aggs(f, enr, real)
    aggs += [
        F.max_by("journal_id", F.when(real, F.col("seq"))).alias("journal_id"),
        F.max_by("url", F.when(real, F.col("seq"))).alias("normalized_url"),
        rank_status(F.max(status_rank(F.col("metadata_status")))).alias("metadata_status"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("n_items"),
    ]
    m = resolved.groupBy("entity").agg(*aggs)
    order = [f for f in ENRICHABLE_FIELD_ORDER if f in fields]
    flags = F.filter(F.array(*[F.when(F.col(f"{f}_enriched"), F.lit(f)) for f in order]), lambda x: x.isNotNull())
    return m.withColumn("enriched_fields", flags)
