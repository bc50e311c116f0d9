"""Enrichment and journal upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litfeed.constants import ABSTRACT_PLACEHOLDERS, AUTHOR_PLACEHOLDERS, SEPARATOR_TAGS, TITLE_PLACEHOLDERS
from litfeed.operators import enrich as E
from litfeed.operators import feedstate as FS
from litfeed.operators import journals as J
from litfeed.plans.common import Ctx, sql_casefold, sql_ts, ts_text
from litfeed.plans.oracle_views import with_views
from litfeed.plans.registry import query
from litfeed.sources import standins

_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{Z}]+"
_SEP = "|".join(SEPARATOR_TAGS)


def sql_clean(x: str) -> str:
    s = f"regexp_replace({x}, '(?i)<\\s*/?\\s*(?:[\\w.-]+:)?(?:{_SEP})([\\s/][^>]*)?>', ' ', 'g')"
    s = f"regexp_replace({s}, '<\\s*/?\\s*[A-Za-z][^>]*>', '', 'g')"
    return f"nullif(trim(regexp_replace({s}, '{_WS}', ' ', 'g')), '')"


def _key(x):
    return f"trim(regexp_replace(regexp_replace({sql_casefold(x)}, '\\p{{P}}', '', 'g'), '{_WS}', ' ', 'g'))"


def _known(x, ph):
    lst = ", ".join(f"'{p}'" for p in ph)
    return f"coalesce({x} IS NOT NULL AND {_key(x)} <> '' AND {_key(x)} NOT IN ({lst}), false)"


def _authors_known(lst):
    return f"coalesce(list_bool_or(list_transform({lst}, lambda a: {_known('a', AUTHOR_PLACEHOLDERS)})), false)"


_B = "(^|[^\\p{L}\\p{N}_])"
_E = "([^\\p{L}\\p{N}_]|$)"


def _sql_type(t):
    w = lambda words: f"regexp_matches({t}, '(?i){_B}({words}){_E}')"
    return (f"CASE WHEN {w('correction|erratum|corrigendum')} THEN 'correction' WHEN {w('review')} THEN 'review' "
            f"WHEN {w('editorial|comment|commentary|perspective|letter\\s+to\\s+the\\s+editor')} THEN 'editorial' "
            f"WHEN {w('research|article|letter')} THEN CASE WHEN {w('news\\s+article')} THEN 'other' ELSE 'research' END "
            f"ELSE 'other' END")


SQL_PAYLOADS = {
    "q_src": """SELECT ((doc_id * 7) % 200) % 80 AS doi_no, arg_max(text, doc_id) AS text FROM documents GROUP BY 1""",
    "q_crossref": """
SELECT '10.5555/' || CAST(doi_no AS VARCHAR) AS doi, CASE WHEN doi_no % 9 = 4 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN doi_no % 10 = 3 THEN 'not json' WHEN doi_no % 10 = 6 THEN '{"message": "x"}'
    WHEN doi_no % 2 = 0 THEN to_json({'message': {'title': ['N/A', substring(text, 1, 30)],
        'author': [{'given': w[1], 'family': w[2], 'name': NULL}, {'given': NULL, 'family': NULL, 'name': 'Anonymous'},
                   {'given': w[1], 'family': w[2], 'name': NULL}],
        'abstract': '<p>' || substring(text, 1, 80) || '</p>', 'type': ty}})::VARCHAR
    ELSE to_json({'message': {'title': substring(text, 1, 30), 'author': [{'given': NULL, 'family': NULL, 'name': 'Anonymous'}],
        'abstract': 'Abstract unavailable', 'type': ty}})::VARCHAR END AS payload
FROM (SELECT doi_no, text, string_split(substring(text, 1, 40), ' ') AS w,
        CASE doi_no % 3 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'review-article' ELSE 'other' END AS ty FROM q_src)""",
    "q_unpaywall": """
SELECT '10.5555/' || CAST(doi_no AS VARCHAR) AS doi, 200 AS http_status,
  CASE doi_no % 4 WHEN 0 THEN '{"is_oa": true}' WHEN 1 THEN '{"is_oa": false}' ELSE '{"is_oa": "yes"}' END AS payload
FROM q_src WHERE doi_no % 4 <> 3""",
    "q_cr": """
SELECT doi, coalesce(http_status BETWEEN 200 AND 299 AND strlen(payload) <= 2097152 AND json_valid(payload)
                     AND json_type(pj, '$.message') = 'OBJECT', false) AS cr_ok,
  CASE WHEN json_valid(payload) THEN CASE json_type(pj, '$.message.title')
    WHEN 'ARRAY' THEN json_extract_string(pj, '$.message.title[*]')
    WHEN 'VARCHAR' THEN [json_extract_string(pj, '$.message.title')] END END AS cr_titles,
  CASE WHEN json_valid(payload) AND json_type(pj, '$.message.author') = 'ARRAY' THEN json_extract(pj, '$.message.author[*]') END AS cr_authors,
  CASE WHEN json_valid(payload) AND json_type(pj, '$.message.abstract') = 'VARCHAR' THEN json_extract_string(pj, '$.message.abstract') END AS cr_abstract,
  CASE WHEN json_valid(payload) AND json_type(pj, '$.message.type') = 'VARCHAR' THEN json_extract_string(pj, '$.message.type') END AS cr_type
FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload ELSE 'null' END AS pj FROM q_crossref)""",
    "q_up": """
SELECT doi, coalesce(http_status BETWEEN 200 AND 299 AND strlen(payload) <= 2097152 AND json_valid(payload)
                     AND json_type(pj, '$.is_oa') = 'BOOLEAN', false) AS up_ok,
  CASE WHEN json_valid(payload) AND json_type(pj, '$.is_oa') = 'BOOLEAN' THEN CAST(json_extract(pj, '$.is_oa') AS BOOLEAN) END AS up_is_oa
FROM (SELECT *, CASE WHEN json_valid(payload) THEN payload ELSE 'null' END AS pj FROM q_unpaywall)""",
}

_CLEAN_ABS = sql_clean("cr_abstract")


def _enrich_sql():
    g, f_, n = (sql_clean("json_extract_string(a, '$.given')"), sql_clean("json_extract_string(a, '$.family')"),
                sql_clean("json_extract_string(a, '$.name')"))
    names = f"list_transform(cr_authors, lambda a: CASE WHEN {g} IS NOT NULL OR {f_} IS NOT NULL THEN concat_ws(' ', {g}, {f_}) ELSE {n} END)"
    good = f"list_filter({names}, lambda x: x IS NOT NULL AND {_authors_known('[x]')})"
    return f"""
SELECT seq, doi, coalesce(new_title, title) AS title, array_to_string(coalesce(new_authors, authors), '|') AS authors,
  coalesce(new_abstract, abstract) AS abstract, coalesce(new_type, article_type) AS article_type,
  coalesce(new_oa, oa_status) AS oa_status,
  CASE WHEN has_doi THEN CASE WHEN (CASE metadata_status WHEN 'rss_only' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END)
       >= (CASE WHEN cr_ok2 AND up_ok2 THEN 2 ELSE 1 END) THEN metadata_status
       WHEN cr_ok2 AND up_ok2 THEN 'enriched' ELSE 'partial' END ELSE metadata_status END AS metadata_status,
  array_to_string(CASE WHEN has_doi THEN list_filter(['title', 'authors', 'abstract', 'published_at', 'article_type', 'oa_status'],
     lambda f: list_contains(enriched_fields, f) OR (f = 'title' AND new_title IS NOT NULL) OR (f = 'authors' AND new_authors IS NOT NULL)
       OR (f = 'abstract' AND new_abstract IS NOT NULL) OR (f = 'article_type' AND new_type IS NOT NULL) OR (f = 'oa_status' AND new_oa IS NOT NULL))
     ELSE enriched_fields END, ',') AS enriched_fields
FROM (SELECT *,
  CASE WHEN cr_ok2 AND NOT {_known(sql_clean('title'), TITLE_PLACEHOLDERS)} THEN
    list_filter(list_transform(cr_titles, lambda t: {sql_clean('t')}), lambda t: t IS NOT NULL AND {_known('t', TITLE_PLACEHOLDERS)})[1] END AS new_title,
  CASE WHEN cr_ok2 AND NOT {_authors_known(f"list_transform(authors, lambda a: {sql_clean('a')})")} AND len(cr_auth) > 0 THEN cr_auth END AS new_authors,
  CASE WHEN cr_ok2 AND NOT {_known(sql_clean('abstract'), ABSTRACT_PLACEHOLDERS)} AND {_known(_CLEAN_ABS, ABSTRACT_PLACEHOLDERS)} THEN {_CLEAN_ABS} END AS new_abstract,
  CASE WHEN cr_ok2 AND {sql_casefold('article_type')} = 'other' AND {sql_clean('cr_type')} IS NOT NULL
       AND {_sql_type(sql_clean('cr_type'))} <> 'other' THEN {_sql_type(sql_clean('cr_type'))} END AS new_type,
  CASE WHEN up_ok2 THEN CASE WHEN up_is_oa THEN 'open' ELSE 'closed' END END AS new_oa
FROM (SELECT r.*, c.cr_titles, c.cr_abstract, c.cr_type, u.up_is_oa,
        r.doi IS NOT NULL AND trim(r.doi) <> '' AS has_doi,
        r.doi IS NOT NULL AND trim(r.doi) <> '' AND coalesce(c.cr_ok, false) AS cr_ok2,
        r.doi IS NOT NULL AND trim(r.doi) <> '' AND coalesce(u.up_ok, false) AS up_ok2,
        (SELECT list_filter(g, lambda x, i: list_position(list_transform(g, lambda y: {sql_casefold('y')}), {sql_casefold('x')}) = i)
         FROM (SELECT {good} AS g)) AS cr_auth
      FROM q_records r LEFT JOIN (SELECT * FROM q_cr) c ON c.doi = r.doi LEFT JOIN q_up u ON u.doi = r.doi))"""


SQL_RECORDS = {"q_records": """
SELECT *, CASE WHEN seq % 2 = 0 THEN ['et al.'] ELSE [substring(title, 1, 8)] END AS authors,
  CASE WHEN enriched AND title <> 'N/A' THEN ['title'] ELSE CAST([] AS VARCHAR[]) END AS enriched_fields FROM v_items"""}


@query("enrich_left_join", "D-9, A-11, A-12, I-1..I-7", with_views(_enrich_sql(), "v_items",
                                                                    extra={**SQL_PAYLOADS, **SQL_RECORDS}))
def enrich_left_join(spark, sf_dir):
    Ctx(spark, sf_dir)
    recs = standins.item_records(spark, sf_dir)
    out = E.enrich(recs, standins.crossref(spark, sf_dir), standins.unpaywall(spark, sf_dir))
    return out.select("seq", "doi", "title", F.array_join("authors", "|").alias("authors"), "abstract", "article_type",
                      "oa_status", "metadata_status", F.array_join("enriched_fields", ",").alias("enriched_fields"))


@query("journal_upsert", "H-4, A-9", with_views(f"""
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name,
  CASE WHEN n.id IS NOT NULL THEN n.publisher ELSE o.publisher END AS publisher,
  CASE WHEN n.id IS NOT NULL THEN n.feed_url ELSE o.feed_url END AS feed_url,
  CASE WHEN n.id IS NOT NULL THEN n.enabled ELSE o.enabled END AS enabled,
  o.etag, o.last_modified, o.last_checked_at, o.last_success_at, coalesce(o.last_status, 'never') AS last_status, o.last_error
FROM v_journals n FULL OUTER JOIN (
  SELECT 'src' || substring(s.feed_id, 2) AS id, 'Old name ' || s.feed_id AS name, 'aps' AS publisher,
    'https://old.example.org/' || s.feed_id AS feed_url, false AS enabled, s.etag, s.last_modified,
    {sql_ts('s.last_checked_at')} AS last_checked_at, {sql_ts('s.last_success_at')} AS last_success_at, s.last_status, s.last_error
  FROM (SELECT feed_id,
      (arg_max({{'v': etag}}, seq) FILTER (WHERE status = 'ok' OR etag IS NOT NULL)).v AS etag,
      (arg_max({{'v': last_modified}}, seq) FILTER (WHERE status = 'ok' OR last_modified IS NOT NULL)).v AS last_modified,
      arg_max(checked_at, seq) AS last_checked_at, max(checked_at) FILTER (WHERE status IN ('ok', 'not_modified')) AS last_success_at,
      arg_max(status, seq) AS last_status, (arg_max({{'v': CASE WHEN status IN ('ok', 'not_modified') THEN NULL ELSE error END}}, seq)).v AS last_error
    FROM v_fetches GROUP BY feed_id) s WHERE CAST(substring(s.feed_id, 2) AS INTEGER) % 2 = 0) o ON o.id = n.id""",
    "v_journals", "v_fetches"))
def journal_upsert(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    st = FS.final_state(c.fetches()).where(F.substring("feed_id", 2, 10).cast("int") % 2 == 0)
    existing = st.select(
        F.concat(F.lit("src"), F.substring("feed_id", 2, 10)).alias("id"), F.concat(F.lit("Old name "), "feed_id").alias("name"),
        F.lit("aps").alias("publisher"), F.concat(F.lit("https://old.example.org/"), "feed_id").alias("feed_url"),
        F.lit(False).alias("enabled"), "etag", "last_modified", ts_text("last_checked_at").alias("last_checked_at"),
        ts_text("last_success_at").alias("last_success_at"), "last_status", "last_error")
    return J.upsert_catalogue(existing, c.journals())
