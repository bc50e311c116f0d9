"""Conflicting identities (H-9, §2.3) by set-based rounds.

Items come in an order (``seq``). The first accepted item of a key fixes what the key stands for: a DOI and a URL belong to one
journal, a URL to one DOI. A later item that says otherwise is rejected, and fixes nothing. Since items without a contested
key are never rejected, only those with one take part:

1. contested keys: a URL with several DOIs or journals, a DOI with several journals (aggregates, combined map-side);
2. rounds: an item that contradicts a fixed key is rejected; one that is the earliest open item of each of its open keys (or
   has none left) is accepted and fixes its keys; all others wait. The earliest open item is always settled, so rounds end; each
   is a checkpoint, and their number follows the longest chain of items that wait for one another, not the number of items.

No component is gathered anywhere: rounds are joins and ``min`` by key, so a hot key is spread as any other join is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.operators import identity as I
from litfeed.operators import merge as M
from litfeed.session import checkpoint_dir

CONFLICT = "RepositoryConflictError"

#: What a key may stand for: (kind, key column, value column).
CLAIMS = (("url_journal", "url", "journal_id"), ("doi_journal", "doi", "journal_id"), ("url_doi", "url", "doi"))


def claims(items: DataFrame) -> DataFrame:
    """(seq, kind, key, value): what each item says about its keys."""
    parts = [items.where(F.col(k).isNotNull() & F.col(v).isNotNull()).select(
        "seq", F.lit(kind).alias("kind"), F.col(k).alias("key"), F.col(v).alias("value")) for kind, k, v in CLAIMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def contradictions(items: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(seq) of the items that contradict an earlier accepted one. ``fixed``: (kind, key, value) of stored records."""
    spark = items.sparkSession
    checkpoint_dir(spark)
    said = claims(items)
    known = fixed.distinct() if fixed is not None else spark.createDataFrame([], "kind string, key string, value string")
    every = said.select("kind", "key", "value").unionByName(known.select("kind", "key", "value"))
    contested = every.groupBy("kind", "key").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b").select("kind", "key")
    pending = said.join(contested, ["kind", "key"], "left_semi").checkpoint(eager=True)
    known = known.join(contested, ["kind", "key"], "left_semi").checkpoint(eager=True)
    rejected = None
    while not pending.isEmpty():
        seen = pending.join(known.withColumnRenamed("value", "stands"), ["kind", "key"], "left")
        judged = seen.groupBy("seq").agg(F.bool_or(F.coalesce(F.col("value") != F.col("stands"), F.lit(False))).alias("bad"))
        bad = judged.where("bad").select("seq").checkpoint(eager=True)
        rest = seen.join(bad, "seq", "left_anti")
        first = rest.where(F.col("stands").isNull()).groupBy("kind", "key").agg(F.min("seq").alias("first"))
        turn = rest.join(first, ["kind", "key"], "left")
        good = turn.groupBy("seq").agg(F.bool_and(F.col("stands").isNotNull() | (F.col("seq") == F.col("first"))).alias("ok")).where("ok")
        taken = rest.join(good.select("seq"), "seq", "left_semi").checkpoint(eager=True)
        known = known.unionByName(taken.where(F.col("stands").isNull()).select("kind", "key", "value")).distinct().checkpoint(eager=True)
        pending = rest.select("kind", "key", "seq", "value").join(taken.select("seq").distinct(), "seq", "left_anti").checkpoint(eager=True)
        rejected = bad if rejected is None else rejected.unionByName(bad)
    return rejected if rejected is not None else said.select("seq").where("false")


def resolve_with_conflicts(items: DataFrame, fields=M.MERGED_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(articles, quarantine): the accepted items merged by entity with all ``fields``, and (seq, error_class) of the others."""
    bad = contradictions(items).checkpoint(eager=True)
    merged = M.merge(I.resolve(items.join(bad, "seq", "left_anti")), fields=fields)
    return merged, bad.select("seq", F.lit(CONFLICT).alias("error_class"))
