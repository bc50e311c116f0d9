"""The engine's public surface under the names a feed-pipeline user expects.

Every function takes and returns DataFrames (or one small dict/row where the
answer is a scalar report).
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame

from litfeed.operators import classify as _classify
from litfeed.operators import gate as _gate
from litfeed.operators import runs as _runs
from litfeed.operators import search as _search
from litfeed.operators import snapshot as _snapshot
from litfeed.operators.enrich import enrich  # noqa: F401  (records, crossref, unpaywall) -> records
from litfeed.session import checkpoint_dir
from litfeed.sources.feeds import canonicalize  # noqa: F401  (raw_items, journals) -> article events
from litfeed.sources.feeds import parse_feeds as ingest  # noqa: F401  raw_feeds -> raw items / bad bodies
from litfeed.streaming import incremental as _inc
from litfeed.streaming.incremental import run_stream as ingest_stream  # noqa: F401

SearchRequest = _search.SearchRequest


def upsert(articles: DataFrame | None, url_aliases: DataFrame | None, article_events: DataFrame, run_id: int = 0, at: datetime | None = None):
    """Apply canonical article events to the stored articles; returns (articles, url_aliases). ``upserted`` gives more."""
    done = upserted(articles, url_aliases, article_events, run_id, at)
    return done.articles(articles), done.url_aliases(url_aliases)


def upserted(articles: DataFrame | None, url_aliases: DataFrame | None, article_events: DataFrame, run_id: int = 0,
             at: datetime | None = None) -> _inc.Upserted:
    """As ``upsert``, with the outcome of each item, the rejected ones, and the links of merged rows (``.links(article_tags)``)."""
    checkpoint_dir(article_events.sparkSession)
    items = _inc._batch_items(article_events, run_id).checkpoint(eager=True)  # read by every step; canonical events are costly
    return _inc.upsert(articles, url_aliases, items, run_id, at or datetime.now(UTC))


def reclassify(articles: DataFrame, rules: DataFrame, topics: DataFrame, gates: DataFrame,
               method: str = "auto") -> DataFrame:
    """Full retag: the article_tags bridge table."""
    return _classify.classify(articles, rules, topics, gates, method=method)


def search(articles: DataFrame, journals: DataFrame, article_tags: DataFrame, tags: DataFrame,
           **request) -> tuple[DataFrame, int]:
    """One page of results and the total count (query, date_from, date_to, journal, publisher,
    article_type, oa_status, tags, sort, page, page_size)."""
    req = _search.SearchRequest(**request)
    total = _search.filtered(articles, journals, article_tags, req).count()
    return _search.page_rows(articles, journals, article_tags, tags, req), total


def filter_options(articles: DataFrame, journals: DataFrame, tags: DataFrame) -> DataFrame:
    return _search.facet_options(articles, journals, tags)


def run_summary(checks: DataFrame) -> DataFrame:
    return _runs.run_summary(checks)


def quality_report(articles: DataFrame, journals: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    return _gate.quality_report(articles, journals, runs)


def publish(spark, root: str, base: str) -> None:
    _snapshot.publish(spark, root, base)
