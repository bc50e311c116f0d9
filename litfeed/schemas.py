"""Schemas of the snapshot tables (data model)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampType)

S, B, L, T = StringType(), BooleanType(), LongType(), TimestampType()

ARTICLES = StructType([
    StructField("uid", S), StructField("doi", S), StructField("journal_id", S), StructField("title", S),
    StructField("abstract", S), StructField("authors", ArrayType(S)), StructField("published_at", T),
    StructField("article_type", S), StructField("article_url", S), StructField("normalized_url", S),
    StructField("oa_status", S), StructField("source_feed_url", S), StructField("metadata_status", S),
    StructField("enriched_fields", ArrayType(S)), StructField("first_seen_at", T), StructField("last_updated_at", T),
])
ARTICLE_TAGS = StructType([StructField("article_uid", S), StructField("tag_id", S)])
TAGS = StructType([StructField("id", S), StructField("label", S)])
URL_ALIASES = StructType([StructField("normalized_url", S), StructField("article_uid", S)])
APPLIED_ITEMS = StructType([StructField("journal_id", S), StructField("seq", L), StructField("item_index", IntegerType())])
JOURNALS = StructType([StructField("id", S), StructField("name", S), StructField("publisher", S),
                       StructField("feed_url", S), StructField("enabled", B)])

FEED_STATE = StructType([StructField("feed_id", S), StructField("etag", S), StructField("last_modified", S),
                         StructField("last_checked_at", T), StructField("last_success_at", T),
                         StructField("last_status", S), StructField("last_error", S)])
RUNS = StructType([StructField("run_id", L), StructField("feeds_checked", L), StructField("successful_feeds", L),
                   StructField("failed_feeds", L), StructField("failed", L), StructField("status", S),
                   StructField("items_applied", L), StructField("inserted", L), StructField("updated", L), StructField("skipped", L)])

QUARANTINE = StructType([StructField("journal_id", S), StructField("seq", L), StructField("item_index", IntegerType()),
                         StructField("error_class", S), StructField("run_id", L)])

SNAPSHOT = {"quarantine": QUARANTINE, "articles": ARTICLES, "article_tags": ARTICLE_TAGS, "tags": TAGS, "url_aliases": URL_ALIASES,
            "applied_items": APPLIED_ITEMS, "journals": JOURNALS, "feed_state": FEED_STATE, "runs": RUNS}
