"""Per-row transform queries (B-2..B-8, B-13, B-17, B-19) over derived driver data."""

from __future__ import annotations

from pyspark.sql import functions as F

from litfeed.constants import ENRICHABLE_FIELD_ORDER
from litfeed.functions import articles as AF
from litfeed.functions.dates import normalize_date
from litfeed.functions.text import visible_text
from litfeed.functions.url import normalize_url, strip_tracking
from litfeed.plans.common import Ctx, sql_casefold, sql_ts, ts_text
from litfeed.plans.oracle_views import with_views
from litfeed.plans.registry import query
from litfeed.sources import standins

# ---------------- URL (B-2 .. B-5) ----------------
_URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

SQL_URLS = {"q_urls": """
SELECT page_id, url AS raw_url FROM pages
UNION ALL
SELECT page_id + 1000000000, CASE page_id % 5
  WHEN 0 THEN replace(replace(replace(url, 'https://', 'HTTPS://'), '.example.', '.EXAMPLE.'), '.com/', '.com:443/')
  WHEN 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Gclid=1&keep=%7e%2f&utm_Medium=x&UTM%5Fterm=y&spm=q'
  WHEN 2 THEN replace(replace(url, '/en/', '/en/%61%2f%7E/'), '.org/', '.org.:8080/')
  WHEN 3 THEN replace(url, '://', '://user@')
  ELSE replace(replace(url, 'https://', 'ftp://'), 'http://', 'http://a..b.') END
FROM pages"""}


def _sql_escapes(x: str) -> str:
    hx = "substring(s, 1, 2)"
    ch = f"chr(try_cast('0x' || {hx} AS INTEGER))"
    ishex = f"regexp_matches(s, '^[0-9A-Fa-f]{{2}}')"
    return (f"array_to_string(list_transform(string_split({x}, '%'), lambda s, i: CASE WHEN i = 1 THEN s "
            f"WHEN {ishex} AND regexp_matches({ch}, '^[A-Za-z0-9._~-]$') THEN {ch} || substring(s, 3) "
            f"WHEN {ishex} THEN '%' || upper({hx}) || substring(s, 3) ELSE '%' || s END), '')")


def _sql_strip(q: str) -> str:
    name = "lower(url_decode(replace(split_part(p, '=', 1), '+', ' ')))"
    return (f"CASE WHEN {q} IS NULL OR {q} = '' THEN '' ELSE array_to_string(list_filter(string_split({q}, '&'), "
            f"lambda p: NOT (starts_with({name}, 'utm_') OR {name} IN ('fbclid', 'gclid', 'spm'))), '&') END")


SQL_URL_PARTS = {"q_up": f"""
SELECT page_id, raw_url, c, lower(regexp_extract(c, '{_URL_RE}', 1)) AS scheme, regexp_extract(c, '{_URL_RE}', 2) AS netloc,
  regexp_extract(c, '{_URL_RE}', 3) AS path, regexp_extract(c, '{_URL_RE}', 4) AS query
FROM (SELECT page_id, raw_url, trim(raw_url) AS c FROM q_urls)""", "q_uh": """
SELECT *, regexp_replace(lower(regexp_replace(netloc, ':[0-9]*$', '')), '\\.+$', '') AS host,
  regexp_extract(netloc, ':([0-9]*)$', 1) AS port_txt FROM q_up""", "q_uc": f"""
SELECT page_id, raw_url,
  regexp_matches(c, '{_URL_RE}') AND NOT regexp_matches(c, '[\\s\\x00-\\x1F\\x7F-\\x9F\\p{{Z}}]') AND NOT contains(netloc, '@')
   AND regexp_matches(lower(regexp_replace(netloc, ':[0-9]*$', '')), '^[a-z0-9.-]+$')
   AND scheme IN ('http', 'https') AND (port_txt = '' OR try_cast(port_txt AS DOUBLE) <= 65535)
   AND length(host) > 0 AND length(host) <= 253
   AND (regexp_matches(host, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$')
        OR (list_bool_and(list_transform(string_split(host, '.'), lambda lab: regexp_matches(lab, '^[a-z0-9-]{{1,63}}$')
              AND NOT starts_with(lab, '-') AND NOT ends_with(lab, '-')))
            AND NOT regexp_matches(host, '^[0-9.]+$'))) AS ok,
  scheme || '://' || CASE WHEN port_txt = '' OR (scheme = 'http' AND try_cast(port_txt AS INTEGER) = 80)
    OR (scheme = 'https' AND try_cast(port_txt AS INTEGER) = 443) THEN host ELSE host || ':' || CAST(try_cast(port_txt AS INTEGER) AS VARCHAR) END
  || CASE WHEN length(p1) > 1 THEN CASE WHEN regexp_replace(p1, '/+$', '') = '' THEN '/' ELSE regexp_replace(p1, '/+$', '') END ELSE p1 END
  || CASE WHEN q1 <> '' THEN '?' || q1 ELSE '' END AS canon
FROM (SELECT *, {_sql_escapes("CASE WHEN path = '' THEN '/' ELSE path END")} AS p1, {_sql_strip(_sql_escapes('query'))} AS q1 FROM q_uh)"""}


@query("url_canonical_ascii", "B-2, B-3, B-4", with_views(
    "SELECT page_id, raw_url, CASE WHEN ok THEN canon END AS normalized_url FROM q_uc", extra={**SQL_URLS, **SQL_URL_PARTS}))
def url_canonical_ascii(spark, sf_dir):
    u = standins.raw_urls(spark, sf_dir)
    return u.select("page_id", "raw_url", normalize_url(F.col("raw_url")).alias("normalized_url"))


@query("url_strip_tracking", "B-5", with_views(
    f"SELECT page_id, {_sql_strip('q')} AS kept_query FROM (SELECT page_id, regexp_extract(trim(raw_url), '{_URL_RE}', 4) AS q FROM q_urls)",
    extra=SQL_URLS))
def url_strip_tracking(spark, sf_dir):
    u = standins.raw_urls(spark, sf_dir)
    q = F.regexp_extract(F.trim("raw_url"), _URL_RE, 4)
    return u.select("page_id", strip_tracking(q).alias("kept_query"))


# ---------------- dates (B-6) ----------------
SQL_DATES = {"q_dates": """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN replace(t, '2024', '1899') ELSE t END AS raw_date FROM (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
    WHEN 2 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
    WHEN 3 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' -0500'
    WHEN 4 THEN strftime(ts, '%Y-%m-%d')
    ELSE 'week ' || CAST(event_id AS VARCHAR) END AS t
  FROM events)""", "q_parsed": """
SELECT event_id, raw_date, CASE
  WHEN regexp_matches(raw_date, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(raw_date, '%Y-%m-%d')
  WHEN regexp_matches(raw_date, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$') THEN try_strptime(left(raw_date, 19), '%Y-%m-%dT%H:%M:%S')
  WHEN regexp_matches(raw_date, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}[+-]\\d{2}:\\d{2}$') THEN
    try_strptime(left(raw_date, 19), '%Y-%m-%dT%H:%M:%S')
      - to_minutes(CAST((CASE WHEN substring(raw_date, 20, 1) = '-' THEN -1 ELSE 1 END)
                   * (CAST(substring(raw_date, 21, 2) AS INTEGER) * 60 + CAST(substring(raw_date, 24, 2) AS INTEGER)) AS BIGINT))
  WHEN regexp_matches(raw_date, '^[A-Za-z]{3}, .* GMT$') THEN try_strptime(substring(raw_date, 6, length(raw_date) - 9), '%d %b %Y %H:%M:%S')
  WHEN regexp_matches(raw_date, '^[A-Za-z]{3}, .* [+-]\\d{4}$') THEN
    try_strptime(substring(raw_date, 6, length(raw_date) - 11), '%d %b %Y %H:%M:%S')
      - to_minutes(CAST((CASE WHEN substring(raw_date, length(raw_date) - 4, 1) = '-' THEN -1 ELSE 1 END)
                   * (CAST(substring(raw_date, length(raw_date) - 3, 2) AS INTEGER) * 60 + CAST(right(raw_date, 2) AS INTEGER)) AS BIGINT))
  END AS ts FROM q_dates"""}


@query("date_normalize", "B-6", with_views(f"""
SELECT event_id, raw_date, CASE WHEN year(ts) BETWEEN 1900 AND 2100 THEN {sql_ts('ts')} END AS published_at FROM q_parsed""",
    extra=SQL_DATES))
def date_normalize(spark, sf_dir):
    d = standins.raw_dates(spark, sf_dir)
    Ctx(spark, sf_dir)
    return d.select("event_id", "raw_date", ts_text(normalize_date(F.col("raw_date"))).alias("published_at"))


# ---------------- article type (B-7) ----------------
_TYPE_PHRASES = ("Research Article", "News Article", "Review article", "Correction to a News Article",
                 "Letter to the Editor", "Preview", "Commentary", "Erratum", "letter", "Perspective piece")
_B = "(^|[^\\p{L}\\p{N}_])"
_E = "([^\\p{L}\\p{N}_]|$)"


def _sql_word(words: str) -> str:
    return f"regexp_matches(t, '(?i){_B}({words}){_E}')"


SQL_TYPES = {"q_types": "SELECT doc_id, " + "CASE " + " ".join(
    f"WHEN doc_id % {len(_TYPE_PHRASES)} = {i} THEN '{p}'" for i, p in enumerate(_TYPE_PHRASES))
    + " END || ' ' || text AS raw_type FROM documents"}


@query("article_type_rules", "B-7", with_views(f"""
SELECT doc_id, raw_type, CASE
  WHEN {_sql_word('correction|erratum|corrigendum')} THEN 'correction'
  WHEN {_sql_word('review')} THEN 'review'
  WHEN {_sql_word('editorial|comment|commentary|perspective|letter\\s+to\\s+the\\s+editor')} THEN 'editorial'
  WHEN {_sql_word('research|article|letter')} THEN CASE WHEN {_sql_word('news\\s+article')} THEN 'other' ELSE 'research' END
  ELSE 'other' END AS article_type
FROM (SELECT doc_id, raw_type, trim(regexp_replace(raw_type, '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{{Z}}]+', ' ', 'g')) AS t FROM q_types)""",
    extra=SQL_TYPES))
def article_type_rules(spark, sf_dir):
    t = standins.raw_types(spark, sf_dir)
    return t.select("doc_id", "raw_type", AF.article_type(visible_text(F.col("raw_type"))).alias("article_type"))


# ---------------- candidate UID (B-8) ----------------
@query("candidate_uid", "B-8", with_views(f"""
SELECT seq, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi
  WHEN u IS NOT NULL THEN 'url:' || left(sha256(u), 24)
  ELSE 'hash:' || left(sha256(coalesce(journal_id, '') || chr(31) || {sql_casefold("coalesce(title, '')")} || chr(31)
                      || coalesce(strftime(published_at, '%Y-%m-%d'), '')), 24) END AS uid
FROM (SELECT *, CASE WHEN seq % 9 = 0 THEN NULL ELSE url END AS u FROM v_items)""", "v_items"))
def candidate_uid(spark, sf_dir):
    i = Ctx(spark, sf_dir).items()
    u = F.when(F.col("seq") % 9 != 0, F.col("url"))
    return i.select("seq", AF.candidate_uid(F.col("doi"), u, F.col("journal_id"), F.col("title"),
                                            F.date_format("published_at", "yyyy-MM-dd")).alias("uid"))


# ---------------- meaningful values (B-17) ----------------
def _sql_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_casefold(x)}, '\\p{{P}}', '', 'g'), '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{{Z}}]+', ' ', 'g'))"


def _sql_known(x: str, placeholders) -> str:
    lst = ", ".join(f"'{p}'" for p in placeholders)
    return f"coalesce({x} IS NOT NULL AND {_sql_key(x)} <> '' AND {_sql_key(x)} NOT IN ({lst}), false)"


@query("meaningful_fields", "B-17, C-11", with_views(f"""
SELECT seq, {_sql_known('title', AF.TITLE_PLACEHOLDERS)} AS title_known,
  {_sql_known('abstract', AF.ABSTRACT_PLACEHOLDERS)} AS abstract_known,
  coalesce(list_bool_or(list_transform(authors, lambda a: {_sql_known('a', AF.AUTHOR_PLACEHOLDERS)})), false) AS authors_known,
  published_at IS NOT NULL AS published_known,
  coalesce(trim(article_type) <> '' AND lower(article_type) <> 'other', false) AS type_known,
  coalesce(oa_status IN ('open', 'closed'), false) AS oa_known
FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN ['Unknown Author', 'et al.'] WHEN seq % 3 = 1 THEN ['N.A.', substring(title, 1, 8)]
                     ELSE CAST([] AS VARCHAR[]) END AS authors FROM v_items)""", "v_items"))
def meaningful_fields(spark, sf_dir):
    i = Ctx(spark, sf_dir).items()
    s = F.col("seq")
    authors = (F.when(s % 3 == 0, F.array(F.lit("Unknown Author"), F.lit("et al.")))
               .when(s % 3 == 1, F.array(F.lit("N.A."), F.substring("title", 1, 8)))
               .otherwise(F.array().cast("array<string>")))
    return i.withColumn("authors", authors).select(
        "seq", *[AF.KNOWN[f](F.col(f)).alias(f"{f.split('_')[0] if f != 'article_type' else 'type'}_known")
                 for f in ENRICHABLE_FIELD_ORDER])


# ---------------- authors (B-13) ----------------
@query("authors_distinct", "B-13", with_views(f"""
SELECT doc_id, array_to_string(kept, '|') AS authors, len(kept) AS n_authors FROM (
  SELECT doc_id, list_filter(c, lambda a, i: list_position(k, {sql_casefold('a')}) = i) AS kept FROM (
    SELECT doc_id, c, list_transform(c, lambda a: {sql_casefold('a')}) AS k FROM (
      SELECT doc_id, list_filter(list_transform(string_split(text, ' '),
               lambda a: trim(regexp_replace(a, '[\\s\\p{{Z}}]+', ' ', 'g'))), lambda a: a IS NOT NULL AND a <> '') AS c
      FROM documents)))""", extra={}))
def authors_distinct(spark, sf_dir):
    d = Ctx(spark, sf_dir).table("documents")
    kept = AF.distinct_authors(F.split("text", " ", -1))
    return d.select("doc_id", F.array_join(kept, "|").alias("authors"), F.size(kept).cast("bigint").alias("n_authors"))


# ---------------- provenance (B-19) ----------------
def _raw_fields_spark():
    s = F.col("seq")
    parts = [F.when(s % 2 == 1, F.lit("oa_status")), F.when(s % 5 == 0, F.lit("abstract")),
             F.when(s % 3 == 0, F.lit("title")), F.when(s % 7 == 0, F.lit("bogus")),
             F.when(s % 4 == 0, F.lit("title")), F.when(s % 11 == 0, F.lit("authors"))]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


@query("provenance_order", "B-19", with_views("""
SELECT seq, array_to_string(list_filter(['title', 'authors', 'abstract', 'published_at', 'article_type', 'oa_status'],
                                         lambda f: list_contains(raw, f)), ',') AS enriched_fields,
  len(list_filter(raw, lambda f: f NOT IN ('title', 'authors', 'abstract', 'published_at', 'article_type', 'oa_status'))) AS n_unknown
FROM (SELECT seq, list_filter([CASE WHEN seq % 2 = 1 THEN 'oa_status' END, CASE WHEN seq % 5 = 0 THEN 'abstract' END,
        CASE WHEN seq % 3 = 0 THEN 'title' END, CASE WHEN seq % 7 = 0 THEN 'bogus' END,
        CASE WHEN seq % 4 = 0 THEN 'title' END, CASE WHEN seq % 11 = 0 THEN 'authors' END], lambda x: x IS NOT NULL) AS raw
      FROM v_items)""", "v_items"))
def provenance_order(spark, sf_dir):
    i = Ctx(spark, sf_dir).items().select("seq", _raw_fields_spark().alias("raw"))
    return i.select("seq", F.array_join(AF.provenance_order(F.col("raw")), ",").alias("enriched_fields"),
                    F.size(F.filter("raw", lambda f: ~f.isin(*ENRICHABLE_FIELD_ORDER))).cast("bigint").alias("n_unknown"))
