"""Catalogue rules as checks (A-5, A-6, Q-7, Q-8, E-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.constants import PUBLISHERS
from litfeed.functions.text import visible_text, match_normalize
from litfeed.functions.url import normalize_url


def _count(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def _dups(df: DataFrame, key) -> DataFrame:
    return df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def feed_checks(feeds: DataFrame) -> DataFrame:
    """Unique id, unique canonical URL, HTTPS, usable host, known publisher, boolean flag."""
    canon = normalize_url(F.col("feed_url"))
    parts = [
        _count("feed_duplicate_id", _dups(feeds, F.col("id"))),
        _count("feed_duplicate_url", _dups(feeds.where(canon.isNotNull()), canon)),
        _count("feed_not_https", feeds.where(~F.lower(F.trim("feed_url")).startswith("https://"))),
        _count("feed_bad_url", feeds.where(canon.isNull())),
        _count("feed_unknown_publisher", feeds.where(~F.lower("publisher").isin(*PUBLISHERS))),
        _count("feed_enabled_not_boolean", feeds.where(F.col("enabled").isNull())),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topic_checks(groups: DataFrame, topics: DataFrame, rules: DataFrame, gates: DataFrame) -> DataFrame:
    """Group orders 1..n, no empty group, >= 1 keyword per topic, keywords unique after
    match normalisation, gates name other known groups."""
    n = groups.agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"),
                   F.count_distinct("ord").alias("d"))
    kw = rules.withColumn("kw", match_normalize(visible_text(F.col("keyword"))))
    tg = topics.select("topic_id", F.col("group_id").alias("own_group"))
    parts = [
        _count("group_order_not_continuous", n.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")))),
        _count("group_empty", groups.join(topics, groups.id == topics.group_id, "left_anti")),
        _count("topic_unknown_group", topics.join(groups, topics.group_id == groups.id, "left_anti")),
        _count("topic_without_keyword", topics.join(rules, "topic_id", "left_anti")),
        _count("keyword_duplicate", _dups(kw.where(F.col("kw").isNotNull()), F.col("kw"))),
        _count("gate_unknown_group", gates.join(groups, gates.required_group == groups.id, "left_anti")),
        _count("gate_own_group", gates.join(tg, "topic_id").where(F.col("required_group") == F.col("own_group"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
