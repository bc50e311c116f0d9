"""DuckDB twins of the stand-in views; every oracle query is ``WITH <views> <body>``."""

from __future__ import annotations

from litfeed.constants import PUBLISHERS
from litfeed.sources import catalog

_pub_case = "CASE " + " ".join(f"WHEN num % 8 = {i} THEN '{p}'" for i, p in enumerate(PUBLISHERS)) + " END"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_articles": ("""
SELECT 'doc:' || CAST(d.doc_id AS VARCHAR) AS uid,
  CASE WHEN d.doc_id % 4 <> 0 THEN '10.5555/d' || CAST(d.doc_id AS VARCHAR) END AS doi,
  d.source AS journal_id,
  substring(d.text, 1, 60) AS title,
  d.text AS abstract,
  CASE WHEN d.doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id // 3 AS BIGINT)) END AS published_at,
  CASE d.doc_id % 5 WHEN 0 THEN 'research' WHEN 1 THEN 'review' WHEN 2 THEN 'editorial' WHEN 3 THEN 'correction' ELSE 'other' END AS article_type,
  'https://ex.org/a/' || CAST(d.doc_id AS VARCHAR) AS article_url,
  CASE WHEN l.quality = 1 THEN 'open' WHEN l.quality = 0 THEN 'closed' ELSE 'unknown' END AS oa_status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""", ()),
    "v_journals": (f"""
SELECT source AS id, 'Journal ' || source AS name, {_pub_case} AS publisher,
  'https://feeds.example.org/' || source || '.xml' AS feed_url, num % 7 <> 0 AS enabled
FROM (SELECT source, CAST(substring(source, 4, 10) AS BIGINT) AS num FROM (SELECT DISTINCT source FROM documents))""", ()),
    "v_rules": (catalog.rules_sql(), ()),
    "v_topics": (catalog.topics_sql(), ()),
    "v_groups": (catalog.groups_sql(), ()),
    "v_gates": (catalog.gates_sql(), ()),
    "v_tags": ("SELECT topic_id AS id, label FROM v_topics", ("v_topics",)),
    "v_fetches": ("""
SELECT seq, run_id, feed_id, checked_at, status,
  CASE WHEN k % 3 <> 0 THEN 'W/"' || CAST(k AS VARCHAR) || '"' END AS etag,
  CASE WHEN k % 2 = 0 THEN 'lm' || CAST(k % 10 AS VARCHAR) END AS last_modified,
  CASE WHEN status IN ('error', 'partial') THEN 'E' || event_type END AS error,
  k % 7 AS n_items,
  CASE WHEN status = 'partial' THEN 1 + k % 3 ELSE 0 END AS item_errors
FROM (SELECT event_id AS seq, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS run_id,
        'f' || CAST(user_id AS VARCHAR) AS feed_id, ts AS checked_at, event_type,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'ok' WHEN event_type = 'view' THEN 'not_modified'
             WHEN event_type = 'signup' THEN 'partial' WHEN event_type = 'error' THEN 'error' END AS status
      FROM events)""", ()),
}


def _items_sql(conflict: bool) -> str:
    doi = "CASE WHEN doc_id % 3 <> 0 AND doi_no % 8 <> 7 THEN '10.5555/' || CAST(doi_no AS VARCHAR) END"
    journal = "'src' || CAST(doi_no % 20 AS VARCHAR)"
    if conflict:
        doi = (f"CASE WHEN url_no % 50 = 0 AND doc_id % 3 = 1 AND ({doi}) IS NOT NULL "
               f"THEN '10.6666/' || CAST(doi_no AS VARCHAR) ELSE {doi} END")
        journal = f"CASE WHEN doi_no % 40 = 0 AND doc_id % 3 = 2 THEN 'src99' ELSE {journal} END"
    return f"""
SELECT seq, url, doi, journal_id, title, abstract, published_at, article_type, oa_status,
  CASE WHEN doi IS NOT NULL AND seq % 4 = 0 THEN 'enriched' WHEN doi IS NOT NULL AND seq % 6 = 1 THEN 'partial' ELSE 'rss_only' END AS metadata_status,
  (doi IS NOT NULL AND seq % 4 = 0) AS enriched
FROM (SELECT doc_id AS seq, 'https://ex.org/' || CAST(url_no AS VARCHAR) AS url, {doi} AS doi, {journal} AS journal_id,
        CASE WHEN doc_id % 5 = 0 THEN 'N/A' ELSE split_part(text, chr(10), 1) END AS title,
        CASE WHEN doc_id % 7 = 0 THEN 'No abstract' ELSE text END AS abstract,
        CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id AS INTEGER)) END AS published_at,
        CASE doc_id % 6 WHEN 0 THEN 'research' WHEN 1 THEN 'other' WHEN 2 THEN 'review' WHEN 3 THEN 'other' WHEN 4 THEN 'editorial' ELSE 'correction' END AS article_type,
        CASE doc_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'unknown' WHEN 2 THEN 'closed' ELSE 'unknown' END AS oa_status
      FROM (SELECT doc_id, text, (doc_id * 7) % 200 AS url_no, ((doc_id * 7) % 200) % 80 AS doi_no FROM documents))"""


VIEWS["v_items"] = (_items_sql(False), ())
VIEWS["v_items_conflict"] = (_items_sql(True), ())


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named views (and their dependencies) then ``body``.

    ``extra`` adds query-local CTEs (name -> SQL) after the views, in order.
    """
    ordered: list[str] = []

    def add(n: str) -> None:
        if n in ordered:
            return
        for dep in VIEWS[n][1]:
            add(dep)
        ordered.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n][0]}\n)" for n in ordered]
    ctes += [f"{n} AS ({sql}\n)" for n, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
