"""Per-item upsert outcomes (F-1): inserted / updated / skipped.

Row lifetimes: the survivor's own items (phase 0) form one lifetime; the
items of a URL that lived as its own row before being linked to the entity's
DOI (phase < 0) form another. The first item of a lifetime inserts; the item
that links an absorbed URL updates (it merges two rows); any other item is
skipped when the row state after it equals the state before it.

State of a lifetime after item t, per enrichable field:
``coalesce(last own enriched, first absorbed enriched, last own known,
first absorbed known, first own value)`` where absorbed rows count once their
link time is <= t. "Last own ..." are running carries (``carry_last``, split
into chunks so one hot entity never lands in one task); absorbed and first
values are aggregates joined back by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litfeed.functions.articles import KNOWN, status_rank
from litfeed.operators.feedstate import DEFAULT_CHUNK, carry_last
from litfeed.operators.merge import MERGED_FIELDS
from litfeed.session import checkpoint_dir


def _digest(c: Column) -> Column:
    """128 bits that stand for a value (null: null)."""
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")))


def _final(v, known, enr, key):
    """Final value of a lifetime: last enriched, else last known, else first."""
    best_e = F.max_by(F.when(enr, F.struct(v.alias("v"))), F.when(enr, key))
    best_k = F.max_by(F.when(known, F.struct(v.alias("v"))), F.when(known, key))
    first = F.min_by(F.struct(v.alias("v")), key)
    return F.coalesce(best_e, best_k, first)["v"]


def outcomes(resolved: DataFrame, fields=MERGED_FIELDS, enriched_col: str = "enriched",
             chunk: int = DEFAULT_CHUNK, latest: tuple[str, ...] = ()) -> DataFrame:
    """(seq, entity, lifetime, outcome) for every item of ``identity.resolve`` output. ``latest``: further columns that each item
    sets anew."""
    cols = set(resolved.columns)
    if "is_alias" in cols:
        resolved = resolved.where(~F.coalesce("is_alias", F.lit(False)))
    resolved = resolved.withColumns({f"_k_{f}": KNOWN[f](F.col(f)) for f in fields})
    values = []
    for f in fields:
        enr = F.coalesce(F.col(f"{f}_enr") if f"{f}_enr" in cols else F.col(enriched_col), F.lit(False))
        values += [f"_k_{f}", (enr & F.col(f"_k_{f}")).alias(f"_e_{f}"), _digest(F.col(f)).alias(f)]
    r = resolved.select(
        "seq", "entity", "phase", "url", "f_url", "doi", "journal_id", "link_seq", "url_first_seq",
        status_rank(F.col("metadata_status")).alias("rank"), *[_digest(F.col(c)).alias(c) for c in latest], *values,
        F.concat_ws("|", "entity", F.when(F.col("phase") == 0, F.lit("own")).otherwise(F.col("url"))).alias("lifetime"))
    # narrow rows from here on: the texts are read once, not by each aggregate and window below
    checkpoint_dir(r.sparkSession)
    r = r.checkpoint(eager=True)

    # absorbed lifetimes: final values, then per entity the first (by link time) enriched / known one
    ab = r.where(F.col("phase") < 0)
    aggs = [F.max(-F.col("phase")).alias("link"), F.max("rank").alias("rank")]
    for f in fields:
        aggs += [_final(F.col(f), F.col(f"_k_{f}"), F.col(f"_e_{f}"), F.col("seq")).alias(f"fin_{f}"),
                 F.bool_or(F.col(f"_e_{f}")).alias(f"fenr_{f}"), F.bool_or(F.col(f"_k_{f}")).alias(f"fknown_{f}")]
    fin = ab.groupBy("entity", "lifetime").agg(*aggs)
    ent_aggs = [F.min(F.when(F.col("rank") >= 2, F.col("link"))).alias("a_r2"),
                F.min(F.when(F.col("rank") >= 1, F.col("link"))).alias("a_r1")]
    for f in fields:
        kf = F.col(f"fknown_{f}")
        ent_aggs += [F.min_by(F.struct(F.col("link").alias("t"), F.col(f"fin_{f}").alias("v")),
                              F.when(F.col(f"fenr_{f}"), F.col("link"))).alias(f"a_e_{f}"),
                     F.min_by(F.struct(F.col("link").alias("t"), F.col(f"fin_{f}").alias("v")),
                              F.when(kf, F.col("link"))).alias(f"a_k_{f}"),
                     F.min(F.when(F.col(f"fenr_{f}"), F.col("link"))).alias(f"a_flag_{f}")]
    absorbed = fin.groupBy("entity").agg(*ent_aggs)

    # first value of every lifetime (its inserted row)
    first = r.groupBy("lifetime").agg(*[F.min_by(F.struct(F.col(f).alias("v")), "seq").alias(f"first_{f}") for f in fields],
                                      F.min("seq").alias("first_seq"))

    carries = {"c_doi": (F.col("doi").isNotNull(), F.col("doi")),
               "c_r2": (F.col("rank") >= 2, F.lit(True)), "c_r1": (F.col("rank") >= 1, F.lit(True))}
    for f in fields:
        carries[f"c_le_{f}"] = (F.col(f"_e_{f}"), F.col(f))
        carries[f"c_lk_{f}"] = (F.col(f"_k_{f}"), F.col(f))
    s = carry_last(r, "lifetime", "seq", carries, chunk)
    s = s.join(first, "lifetime").join(absorbed, "entity", "left")

    own = F.col("phase") == 0
    vis = lambda c: own & F.col(c).isNotNull() & (F.col(c) <= F.col("seq"))
    state = [F.col("c_doi").alias("doi"), F.col("journal_id"), F.col("url"), *latest,
             F.when(F.col("c_r2").isNotNull() | vis("a_r2"), 2).when(F.col("c_r1").isNotNull() | vis("a_r1"), 1)
             .otherwise(0).alias("rank")]
    for f in fields:
        val = F.coalesce(F.col(f"c_le_{f}"), F.when(vis(f"a_e_{f}.t"), F.col(f"a_e_{f}.v")),
                         F.col(f"c_lk_{f}"), F.when(vis(f"a_k_{f}.t"), F.col(f"a_k_{f}.v")), F.col(f"first_{f}.v"))
        flag = F.col(f"c_le_{f}").isNotNull() | vis(f"a_flag_{f}")
        state += [val.alias(f), flag.alias(f"{f}_enr")]
    s = s.withColumn("state", F.struct(*state))
    s = carry_last(s, "lifetime", "seq", {"prev": (F.lit(True), F.col("state"))}, chunk, exclusive=True)
    # the item that first carries an absorbed URL together with the DOI merges two rows
    absorbing = own & (F.col("seq") == F.col("link_seq")) & (F.col("url") != F.col("f_url")) \
        & (F.col("url_first_seq") < F.col("link_seq"))
    s = s.withColumn("absorbing", F.coalesce(absorbing, F.lit(False)))
    outcome = (F.when(F.col("seq") == F.col("first_seq"), "inserted")
               .when(F.col("absorbing"), "updated")
               .when(F.col("state").eqNullSafe(F.col("prev")), "skipped")
               .otherwise("updated"))
    return s.select("seq", "entity", "lifetime", outcome.alias("outcome"))


def change_times(found: DataFrame, at: DataFrame) -> DataFrame:
    """(entity, first_seen_at, last_updated_at) of ``outcomes`` and the times ``at(seq, at)`` of the items."""
    own = F.col("lifetime") == F.concat_ws("|", "entity", F.lit("own"))
    return found.join(at, "seq").groupBy("entity").agg(
        F.min("at").alias("first_seen_at"),
        F.max_by("at", F.when(own & (F.col("outcome") != "skipped"), F.col("seq"))).alias("last_updated_at"))


def counted(found: DataFrame, *by: str) -> DataFrame:
    """(by, inserted, updated, skipped): outcomes per run."""
    return found.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "skipped")])
