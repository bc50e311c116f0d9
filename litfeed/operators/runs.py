"""Run accounting (E-4, E-5, E-6, E-9, F-4, F-5).

Input: one row per feed check (``run_id, seq, feed_id, status, item_errors``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litfeed.constants import MAX_IDENTIFIER_LENGTH, MAX_ITEM_ERRORS, MAX_NOTE_FEEDS
from litfeed.operators.util import single_row


def feed_outcome(checks: DataFrame) -> DataFrame:
    """E-9: error / not_modified / partial (item errors) / ok per check."""
    outcome = (F.when(F.col("status") == "error", "error")
               .when(F.col("status") == "not_modified", "not_modified")
               .when(F.col("item_errors") > 0, "partial")
               .otherwise("ok"))
    return checks.withColumn("outcome", outcome)


def feed_status_by_feed(checks: DataFrame) -> DataFrame:
    o = feed_outcome(checks)
    n = lambda v: F.count_if(F.col("outcome") == v)
    return o.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("n_checks"), n("ok").alias("n_ok"), n("not_modified").alias("n_not_modified"),
        n("partial").alias("n_partial"), n("error").alias("n_error"),
        F.sum("item_errors").alias("item_errors"), F.max_by("outcome", "seq").alias("last_outcome"))


def run_summary(checks: DataFrame) -> DataFrame:
    """E-4 + E-5: counters and terminal status per run.

    ``failed`` counts failed items and failed feeds together; a feed with item
    errors is successful (partial) for the run.
    """
    return _with_status(feed_outcome(checks).groupBy("run_id").agg(*_sums()))


def _sums() -> list:
    error = F.col("outcome") == "error"
    return [F.count(F.lit(1)).alias("feeds_checked"), F.count_if(~error).alias("successful_feeds"), F.count_if(error).alias("failed_feeds"),
            F.coalesce(F.sum(F.when(~error, F.col("item_errors")).otherwise(0)), F.lit(0)).alias("item_failures")]


def _with_status(sums: DataFrame) -> DataFrame:
    s = sums.withColumn("failed", F.col("item_failures") + F.col("failed_feeds"))
    status = (F.when(F.col("feeds_checked") == 0, "error")
              .when(F.col("successful_feeds") == 0, "error")
              .when(F.col("failed") > 0, "partial")
              .otherwise("ok"))
    return s.withColumn("status", status)


def run_row(run_id: int, checks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """E-4 + E-5 for one run, always one row: without any feed that is switched on the run ends with status error. ``outcomes``:
    (outcome) of the items that the run applied."""
    s = _with_status(feed_outcome(checks).agg(*_sums())).withColumn("run_id", F.lit(run_id).cast("bigint"))
    n = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "skipped")])
    return single_row(s, n)


def item_errors(checks: DataFrame) -> DataFrame:
    """F-5: one row per failed item with its index inside the feed body."""
    o = feed_outcome(checks).where(F.col("item_errors") > 0)
    return o.select("run_id", "seq", F.substring("feed_id", 1, MAX_IDENTIFIER_LENGTH).alias("feed_id"),
                    F.posexplode(F.array_repeat(F.lit("ItemError"), F.col("item_errors").cast("int"))).alias("item_index", "error")) \
        .withColumn("item_index", F.col("item_index").cast("bigint"))


def run_notes(checks: DataFrame) -> DataFrame:
    """E-6 as columns: first 20 item errors per run (seq, item order) and the omitted count.

    ``row_number() <= 20`` lets Spark cut each partition to its local top 20
    before the shuffle (WindowGroupLimit), so a huge run never moves whole.
    """
    e = item_errors(checks)
    w = Window.partitionBy("run_id").orderBy("seq", "item_index")
    top = e.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= MAX_ITEM_ERRORS)
    counts = e.groupBy("run_id").agg(F.greatest(F.count(F.lit(1)) - MAX_ITEM_ERRORS, F.lit(0)).alias("omitted_item_errors"))
    return top.join(counts, "run_id").select("run_id", "rn", "feed_id", "item_index", "error", "omitted_item_errors")


def run_feed_lists(checks: DataFrame) -> DataFrame:
    """E-6 feed lists: first 100 successful / failed feeds per run and omitted counts."""
    o = feed_outcome(checks).withColumn("kind", F.when(F.col("outcome") == "error", "failed").otherwise("successful"))
    w = Window.partitionBy("run_id", "kind").orderBy("seq")
    top = o.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= MAX_NOTE_FEEDS)
    counts = o.groupBy("run_id", "kind").agg(F.greatest(F.count(F.lit(1)) - MAX_NOTE_FEEDS, F.lit(0)).alias("omitted"))
    return top.join(counts, ["run_id", "kind"]).select(
        "run_id", "kind", "rn", F.substring("feed_id", 1, MAX_IDENTIFIER_LENGTH).alias("feed_id"), "omitted")


def latest_run(runs: DataFrame) -> DataFrame:
    """F-4: the row of the highest run id (one aggregate, no sort)."""
    cols = [c for c in runs.columns if c != "run_id"]
    agg = runs.agg(F.max("run_id").alias("run_id"), F.max_by(F.struct(*cols), "run_id").alias("r"))
    return agg.select("run_id", "r.*")
