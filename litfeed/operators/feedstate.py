"""Feed validator state (F-2, J-2).

Rules per check, in ``seq`` order: validators are replaced on ``ok`` (even by
NULL) and otherwise whenever a new one is given;
``last_success_at`` moves on ok / not_modified; ``last_checked_at`` always;
the error is cleared on success and recorded otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litfeed.constants import SUCCESSFUL_FEED_STATUSES

# Rows per ordering chunk when a running carry is split across tasks.
DEFAULT_CHUNK = 1 << 16


def _sets(col: str):
    return (F.col("status") == "ok") | F.col(col).isNotNull()


def final_state(checks: DataFrame) -> DataFrame:
    """State after the last check of each feed: associative aggregates only
    (partial aggregation before the shuffle, any feed size)."""
    ok = F.col("status").isin(*SUCCESSFUL_FEED_STATUSES)
    return checks.groupBy("feed_id").agg(
        F.max_by(F.when(_sets("etag"), F.struct("etag")), F.when(_sets("etag"), F.col("seq")))["etag"].alias("etag"),
        F.max_by(F.when(_sets("last_modified"), F.struct("last_modified")),
                 F.when(_sets("last_modified"), F.col("seq")))["last_modified"].alias("last_modified"),
        F.max_by("checked_at", "seq").alias("last_checked_at"),
        F.max(F.when(ok, F.col("checked_at"))).alias("last_success_at"),
        F.max_by("status", "seq").alias("last_status"),
        F.max_by(F.when(~ok, F.col("error")), "seq").alias("last_error"),
    )


def carry_last(df: DataFrame, key: str, order: str, carries: dict[str, tuple], chunk: int = DEFAULT_CHUNK,
               exclusive: bool = False) -> DataFrame:
    """Running "last value where condition" per key, split so no key lands in one task.

    ``carries`` maps output name -> (condition Column, value Column). Step 1
    carries inside (key, chunk) partitions; step 2 folds each chunk's final
    value into one small row per chunk and carries it across chunks; step 3
    fills rows that had no set value inside their own chunk from the chunk
    carry. Equivalent to one window over the whole key, but a hot key spreads
    over ``rows / chunk`` tasks. ``exclusive=True`` carries over the rows strictly
    before each row (the state a row starts from).
    """
    c = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    end = -1 if exclusive else Window.currentRow
    w_in = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    # all columns at once: one by one, the whole plan is analysed again for each
    c = c.withColumns({f"_{name}": F.last(F.when(cond, F.struct(val.alias("v"))), ignorenulls=True).over(w_in)
                       for name, (cond, val) in carries.items()})
    ends = c.groupBy(key, "_chunk").agg(*[
        F.max_by(F.when(cond, F.struct(val.alias("v"))), F.when(cond, F.col(order))).alias(f"_{n}_end")
        for n, (cond, val) in carries.items()])
    w_x = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_{n}_before": F.last(f"_{n}_end", ignorenulls=True).over(w_x) for n in carries})
    c = c.join(ends.select(key, "_chunk", *[f"_{n}_before" for n in carries]), [key, "_chunk"], "left")
    c = c.withColumns({n: F.coalesce(F.col(f"_{n}"), F.col(f"_{n}_before"))["v"] for n in carries})
    return c.drop("_chunk", *[f"_{n}" for n in carries], *[f"_{n}_before" for n in carries])


def state_history(checks: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """State after every check (window form of F-2)."""
    ok = F.col("status").isin(*SUCCESSFUL_FEED_STATUSES)
    out = carry_last(checks, "feed_id", "seq", {
        "state_etag": (_sets("etag"), F.col("etag")),
        "state_last_modified": (_sets("last_modified"), F.col("last_modified")),
        "last_success_at": (ok, F.col("checked_at")),
    }, chunk)
    return out.select("feed_id", "seq", F.col("state_etag").alias("etag"),
                      F.col("state_last_modified").alias("last_modified"),
                      F.col("checked_at").alias("last_checked_at"), "last_success_at",
                      F.col("status").alias("last_status"), F.when(~ok, F.col("error")).alias("last_error"))


def batch_checks(raw: DataFrame, parsed: DataFrame, failed: DataFrame) -> DataFrame:
    """One check per landed body: not_modified / error (unusable body) / partial
    (item errors) / ok, with the validators the response carried. ``failed``: (journal_id, seq) of each item that failed."""
    body_err = parsed.where(F.col("error_class").isNotNull()).select("feed_id", "seq", F.col("error_class").alias("body_error"))
    item_err = failed.groupBy(F.col("journal_id").alias("feed_id"), "seq").agg(F.count(F.lit(1)).alias("n_item_errors"))
    r = raw.select("feed_id", "seq", "etag", "last_modified", F.coalesce("not_modified", F.lit(False)).alias("not_modified")) \
        .join(body_err, ["feed_id", "seq"], "left").join(item_err, ["feed_id", "seq"], "left")
    status = (F.when(F.col("not_modified"), "not_modified").when(F.col("body_error").isNotNull(), "error")
              .when(F.coalesce("n_item_errors", F.lit(0)) > 0, "partial").otherwise("ok"))
    error = F.when(F.col("body_error").isNotNull(), F.col("body_error")) \
        .when(F.coalesce("n_item_errors", F.lit(0)) > 0, F.concat(F.col("n_item_errors").cast("string"), F.lit(" item error(s)")))
    # a partial or failed check passes no validators on (they are only stored on ok / not_modified)
    keep_validators = F.col("not_modified") | (status == "ok")
    return r.select("feed_id", "seq", status.alias("status"), error.alias("error"),
                    F.when(keep_validators, F.col("etag")).alias("etag"),
                    F.when(keep_validators, F.col("last_modified")).alias("last_modified"),
                    F.when(status == "partial", F.col("n_item_errors")).otherwise(F.lit(0)).alias("item_errors"),
                    F.current_timestamp().alias("checked_at"))


def fold_state(previous: DataFrame | None, checks: DataFrame) -> DataFrame:
    """J-2: previous feed state + this batch's checks -> new state (same rules as ``final_state``)."""
    ok = F.col("status").isin(*SUCCESSFUL_FEED_STATUSES)
    b = checks.groupBy("feed_id").agg(
        F.bool_or(_sets("etag")).alias("etag_set"),
        F.max_by(F.when(_sets("etag"), F.struct("etag")), F.when(_sets("etag"), F.col("seq")))["etag"].alias("b_etag"),
        F.bool_or(_sets("last_modified")).alias("lm_set"),
        F.max_by(F.when(_sets("last_modified"), F.struct("last_modified")),
                 F.when(_sets("last_modified"), F.col("seq")))["last_modified"].alias("b_lm"),
        F.max_by("checked_at", "seq").alias("b_checked"),
        F.max(F.when(ok, F.col("checked_at"))).alias("b_success"),
        F.max_by("status", "seq").alias("b_status"),
        F.max_by(F.when(~ok, F.col("error")), "seq").alias("b_error"))
    if previous is None:
        return b.select("feed_id", F.col("b_etag").alias("etag"), F.col("b_lm").alias("last_modified"),
                        F.col("b_checked").alias("last_checked_at"), F.col("b_success").alias("last_success_at"),
                        F.col("b_status").alias("last_status"), F.col("b_error").alias("last_error"))
    j = previous.join(b, "feed_id", "full_outer")
    seen = F.col("b_status").isNotNull()
    return j.select(
        "feed_id",
        F.when(F.coalesce("etag_set", F.lit(False)), F.col("b_etag")).otherwise(F.col("etag")).alias("etag"),
        F.when(F.coalesce("lm_set", F.lit(False)), F.col("b_lm")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.coalesce("b_checked", "last_checked_at").alias("last_checked_at"),
        F.coalesce("b_success", "last_success_at").alias("last_success_at"),
        F.coalesce("b_status", "last_status").alias("last_status"),
        F.when(seen, F.col("b_error")).otherwise(F.col("last_error")).alias("last_error"))
