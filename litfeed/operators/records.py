"""Stored-record checks and repairs (A-10, B-20, H-10, H-11, Q-9, A-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.constants import ENRICHABLE_FIELD_ORDER
from litfeed.functions import articles as AF
from litfeed.operators.outcomes import counted


def decode_stored(stored: DataFrame) -> DataFrame:
    """A-10: authors / provenance JSON must be lists of strings (provenance of known
    names); rows failing either get ``reject_reason``."""
    v_auth = F.try_parse_json("authors_json")
    v_prov = F.try_parse_json("enriched_fields_json")
    kind = lambda v: F.schema_of_variant(v)
    authors = F.try_variant_get(v_auth, "$", "array<string>")
    prov = F.try_variant_get(v_prov, "$", "array<string>")
    reason = (F.when(v_auth.isNull(), "authors_not_json")
              .when(~kind(v_auth).startswith("ARRAY"), "authors_not_list")
              .when(v_prov.isNull(), "provenance_not_json")
              .when(~kind(v_prov).startswith("ARRAY"), "provenance_not_list")
              .when(F.size(AF.provenance_unknown(prov)) > 0, "provenance_unknown_field"))
    return stored.withColumn("authors", authors).withColumn("enriched_fields", prov).withColumn("reject_reason", reason)


def provenance_violations(records: DataFrame) -> DataFrame:
    """H-10 / Q-9: (key, field) where a field marked enriched has no meaningful value."""
    parts = []
    for f in ENRICHABLE_FIELD_ORDER:
        if f in records.columns:
            parts.append(records.where(F.array_contains("enriched_fields", f) & ~AF.KNOWN[f](F.col(f)))
                         .select("seq", F.lit(f).alias("field")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backfill_provenance(records: DataFrame) -> DataFrame:
    """H-11: rows marked partial/enriched get every field that holds a meaningful value."""
    present = [f for f in ENRICHABLE_FIELD_ORDER if f in records.columns]
    flags = F.filter(F.array(*[F.when(AF.KNOWN[f](F.col(f)), F.lit(f)) for f in present]), lambda x: x.isNotNull())
    return records.withColumn("enriched_fields", F.when(F.col("metadata_status").isin("partial", "enriched"), flags)
                              .otherwise(F.col("enriched_fields")))


def run_ledger(runs: DataFrame, checks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A-13: one terminal row per run id (a replayed run keeps one row). ``outcomes``: (run_id, outcome) of the items of each run."""
    times = checks.groupBy("run_id").agg(F.min("checked_at").alias("started_at"), F.max("checked_at").alias("finished_at"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(f"{c}_count")
    return runs.join(times, "run_id").dropDuplicates(["run_id"]).join(counted(outcomes, "run_id"), "run_id", "left").select(
        F.col("run_id").alias("id"), "started_at", "finished_at", "status", n("inserted"), n("updated"), n("skipped"),
        F.col("failed").cast("bigint").alias("failed_count"))
