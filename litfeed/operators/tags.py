"""Tag maintenance (D-6, H-2, H-3, H-6..H-8, D-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.operators.util import bounded_broadcast


def active_tags(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """D-6: tags that still have a link (semi join)."""
    return tags.join(article_tags.select(F.col("tag_id").alias("id")), "id", "left_semi")


def unused_tags(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """D-6: tags without any link, to be removed (anti join)."""
    return tags.join(article_tags.select(F.col("tag_id").alias("id")), "id", "left_anti")


def migrate_labels(old_tags: DataFrame, old_links: DataFrame, new_tags: DataFrame) -> DataFrame:
    """H-6: when a label moves to a new id, its links follow; result is distinct."""
    moved = old_tags.alias("o").join(new_tags.alias("n"), F.col("o.label") == F.col("n.label")) \
        .where(F.col("o.id") != F.col("n.id")).select(F.col("o.id").alias("tag_id"), F.col("n.id").alias("new_id"))
    links = old_links.join(bounded_broadcast(moved), "tag_id", "left")
    return links.select("article_uid", F.coalesce("new_id", "tag_id").alias("tag_id")).distinct()


def replace_article_links(links: DataFrame, uid_links: DataFrame) -> DataFrame:
    """H-7: drop every link of the articles present in ``uid_links``, add theirs."""
    keep = links.join(uid_links.select("article_uid").distinct(), "article_uid", "left_anti")
    return keep.unionByName(uid_links.select("article_uid", "tag_id")).distinct()


def rekey_links(links: DataFrame, survivors: DataFrame) -> DataFrame:
    """H-3: links of absorbed rows move to the survivor; duplicates collapse."""
    m = survivors.select(F.col("uid").alias("article_uid"), F.col("survivor_uid"))
    return links.join(m, "article_uid", "left").select(
        F.coalesce("survivor_uid", "article_uid").alias("article_uid"), "tag_id").distinct()


def assignment_set_diff(stored: DataFrame, assigned: DataFrame) -> DataFrame:
    """H-2 / D-12: uids assigned but not stored (unknown) and stored but not assigned (omitted)."""
    s = stored.select(F.col("uid").alias("s_uid")).distinct()
    a = assigned.select(F.col("uid").alias("a_uid")).distinct()
    j = s.join(a, s.s_uid == a.a_uid, "full_outer").where(F.col("s_uid").isNull() | F.col("a_uid").isNull())
    return j.select(F.coalesce("s_uid", "a_uid").alias("uid"),
                    F.when(F.col("s_uid").isNull(), "unknown").otherwise("omitted").alias("side"))


def replace_one(links: DataFrame, uids: DataFrame, new_links: DataFrame) -> DataFrame:
    """H-7 for a set of articles: their links become exactly ``new_links``."""
    keep = links.join(uids.select(F.col("uid").alias("article_uid")), "article_uid", "left_anti")
    return keep.unionByName(new_links.select("article_uid", "tag_id")).distinct()
