"""Quality gate over a snapshot (E-8, E-12, D-11, Q-1 .. Q-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.constants import ARTICLE_TYPES, METADATA_STATUSES, MIN_COUNT_RATIO, OA_STATUSES
from litfeed.operators.util import single_row

REQUIRED_ARTICLE_COLUMNS = ("uid", "journal_id", "title", "article_type", "oa_status")


def orphans(pairs: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """D-11: (fk, violations) for child.col -> parent.col, one anti join per FK."""
    out = None
    for name, child, ccol, parent, pcol in pairs:
        bad = child.where(F.col(ccol).isNotNull()).join(
            parent.select(F.col(pcol).alias(ccol)).distinct(), ccol, "left_anti")
        row = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("fk"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def duplicate_keys(keyed: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """E-12 / Q-6: (key_type, key, n) for keys seen more than once."""
    out = None
    for kind, df, col in keyed:
        d = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("key")).agg(F.count(F.lit(1)).alias("n")) \
            .where(F.col("n") > 1).select(F.lit(kind).alias("key_type"), "key", "n")
        out = d if out is None else out.unionByName(d)
    return out


def count_drop(previous: DataFrame, candidate: DataFrame) -> DataFrame:
    """Q-10: candidate count must be at least half the previous (previous 0 is not checked)."""
    r = single_row(previous.agg(F.count(F.lit(1)).alias("previous_count")),
                   candidate.agg(F.count(F.lit(1)).alias("candidate_count")))
    return r.withColumn("passed", (F.col("previous_count") == 0) |
                        (F.col("candidate_count") >= F.col("previous_count") * F.lit(MIN_COUNT_RATIO)))


def stored_violations(articles: DataFrame, aliases: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Q-1 / Q-6 over the stored tables: (rule, violations), one row per rule."""
    fks = orphans([("alias_article", aliases, "article_uid", articles, "uid"), ("link_article", links, "article_uid", articles, "uid"),
                   ("link_tag", links, "tag_id", tags, "id")])
    pair = links.select(F.to_json(F.struct("article_uid", "tag_id")).alias("pair"))
    doubles = duplicate_keys([("alias_url", aliases, "normalized_url"), ("link_pair", pair, "pair"), ("tag_id", tags, "id"),
                              ("tag_label", tags, "label")]).groupBy("key_type").agg(F.sum("n").alias("violations"))
    return fks.unionByName(doubles.select(F.col("key_type").alias("fk"), "violations")).withColumnRenamed("fk", "rule")


def quality_report(articles: DataFrame, journals: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """E-8 + Q-3/Q-5/Q-6 + Q-1(article->journal) + Q-4 in one row."""
    missing = [c for c in REQUIRED_ARTICLE_COLUMNS if c not in articles.columns]
    if missing:
        raise ValueError(f"snapshot lacks required columns: {missing}")
    a = articles.join(journals.select(F.col("id").alias("journal_id"), F.lit(True).alias("_j")), "journal_id", "left")
    bad_enum = (~F.col("article_type").isin(*ARTICLE_TYPES) | ~F.col("oa_status").isin(*OA_STATUSES))
    if "metadata_status" in articles.columns:
        bad_enum = bad_enum | ~F.col("metadata_status").isin(*METADATA_STATUSES)
    metrics = a.agg(
        F.count(F.lit(1)).alias("article_count"),
        F.min("published_at").alias("min_published_at"),
        F.max("published_at").alias("max_published_at"),
        F.count_if(F.coalesce(bad_enum, F.lit(True))).alias("enum_violations"),
        F.count_if(F.col("uid").isNull() | F.col("title").isNull() | F.col("journal_id").isNull()).alias("null_violations"),
        F.count_if(F.col("_j").isNull()).alias("orphan_articles"),
    )
    dup = articles.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_uids"))
    parts = [metrics, dup, journals.agg(F.count(F.lit(1)).alias("journal_count"))]
    if "doi" in articles.columns:
        parts.append(articles.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.count(F.lit(1)).alias("n"))
                     .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_dois")))
    if runs is not None:
        parts.append(runs.agg(F.max_by("status", "run_id").alias("latest_run_status")))
    r = single_row(*parts)
    passed = (F.col("article_count") > 0) & (F.col("enum_violations") == 0) & (F.col("null_violations") == 0) \
        & (F.col("orphan_articles") == 0) & (F.col("duplicate_uids") == 0)
    if "doi" in articles.columns:
        passed = passed & (F.col("duplicate_dois") == 0)
    if runs is not None:
        passed = passed & F.col("latest_run_status").isin("ok", "partial")
    return r.withColumn("passed", passed)
