"""Search, facets and classification queries with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from litfeed.operators import classify as C
from litfeed.operators import search as S
from litfeed.operators import trigrams as G
from litfeed.plans.common import CLASSIFY_VIEWS, SQL_CLASSIFY, Ctx, sql_ts, ts_text
from litfeed.plans.oracle_views import with_views
from litfeed.plans.registry import query
from litfeed.session import checkpoint_dir

A_COLS = ["uid", "doi", "journal_id", "title", "article_type", "oa_status", "journal_name", "publisher"]
SQL_A_COLS = "a.uid, a.doi, a.journal_id, a.title, a.article_type, a.oa_status, j.name AS journal_name, j.publisher"


def _listing(df):
    return df.select(*A_COLS, ts_text("published_at").alias("published"))


def _sql_listing(where: str, extra_views=(), extra=None) -> str:
    body = f"""SELECT {SQL_A_COLS}, {sql_ts('a.published_at')} AS published
FROM v_articles a JOIN v_journals j ON j.id = a.journal_id WHERE {where}"""
    return with_views(body, "v_articles", "v_journals", *extra_views, extra=extra)


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SEARCH_TEXT = "(COALESCE(a.title, '') || ' ' || COALESCE(a.abstract, '') || ' ' || COALESCE(a.doi, ''))"

REQ_TEXT = S.SearchRequest(query="Eaux")


@query("search_text_ascii", "C-1", _sql_listing(f"contains(translate({_SEARCH_TEXT}, {_ASCII}), translate('Eaux', {_ASCII}))"))
def search_text_ascii(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _listing(S.filtered(c.articles(), c.journals(), None, REQ_TEXT))


@query("search_text_indexed", "C-1", _sql_listing(f"contains(translate({_SEARCH_TEXT}, {_ASCII}), translate('Eaux', {_ASCII}))"))
def search_text_indexed(spark, sf_dir):
    """The same rows by a written trigram index."""
    c = Ctx(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/litfeed-trigrams-{uuid.uuid4().hex}"
    G.build(c.articles(), path)
    hits = G.search(spark, path, REQ_TEXT.query)
    return _listing(S.filtered(c.articles().join(hits, "uid", "left_semi"), c.journals(), None, S.SearchRequest()))


REQ_DATES = S.SearchRequest(date_from="2024-01-05", date_to="2024-01-10")


@query("search_date_range", "C-2",
       _sql_listing("CAST(a.published_at AS DATE) >= DATE '2024-01-05' AND CAST(a.published_at AS DATE) <= DATE '2024-01-10'"))
def search_date_range(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _listing(S.filtered(c.articles(), c.journals(), None, REQ_DATES))


REQ_FACETS = S.SearchRequest(publisher="aaas", article_type="research", oa_status="open")


@query("search_facets", "C-3, D-2",
       _sql_listing("j.publisher = 'aaas' AND a.article_type = 'research' AND a.oa_status = 'open'"))
def search_facets(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _listing(S.filtered(c.articles(), c.journals(), None, REQ_FACETS))


REQ_JOURNAL = S.SearchRequest(journal="src3", date_from="2024-01-05")


@query("search_journal", "C-2, C-3",
       _sql_listing("a.journal_id = 'src3' AND CAST(a.published_at AS DATE) >= DATE '2024-01-05'"))
def search_journal(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _listing(S.filtered(c.articles(), c.journals(), None, REQ_JOURNAL))


REQ_TAGS = S.SearchRequest(tags=("t02", " t08", "t02"))
_HAS_TAGS = """EXISTS (SELECT 1 FROM q_article_tags w0 WHERE w0.article_uid = a.uid AND w0.tag_id = 't02')
AND EXISTS (SELECT 1 FROM q_article_tags w1 WHERE w1.article_uid = a.uid AND w1.tag_id = 't08')"""


@query("search_all_tags", "C-4, D-4", _sql_listing(_HAS_TAGS, CLASSIFY_VIEWS, SQL_CLASSIFY))
def search_all_tags(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return _listing(S.filtered(c.articles(), c.journals(), c.article_tags(), REQ_TAGS))


def _page_sql(where: str, order: str, page: int, size: int) -> str:
    extra = dict(SQL_CLASSIFY)
    extra["q_strings"] = """
SELECT l.article_uid AS uid, string_agg(t.id, '|||' ORDER BY t.id) AS tag_ids, string_agg(t.label, '|||' ORDER BY t.id) AS tag_labels
FROM q_article_tags l JOIN v_tags t ON t.id = l.tag_id GROUP BY l.article_uid"""
    extra["q_f"] = f"SELECT a.*, j.name AS journal_name, j.publisher FROM v_articles a JOIN v_journals j ON j.id = a.journal_id WHERE {where}"
    extra["q_p"] = f"SELECT LEAST({page}, GREATEST(1, CAST(ceil((SELECT count(*) FROM q_f) / {size}.0) AS BIGINT))) AS page"
    extra["q_ranked"] = f"SELECT q_f.*, row_number() OVER (ORDER BY {order}) AS rn FROM q_f"
    body = f"""SELECT r.uid, r.doi, r.journal_id, r.title, r.abstract, r.article_type, r.oa_status, r.journal_name, r.publisher,
  {sql_ts('r.published_at')} AS published, s.tag_ids, s.tag_labels,
  CASE WHEN regexp_matches(trim(r.article_url), '^(?i)https?://') THEN trim(r.article_url) END AS safe_url, p.page
FROM q_ranked r CROSS JOIN q_p p LEFT JOIN q_strings s ON s.uid = r.uid
WHERE r.rn > {size} * (p.page - 1) AND r.rn <= {size} * p.page"""
    return with_views(body, "v_journals", "v_tags", *CLASSIFY_VIEWS, extra=extra)


def _page(spark, sf_dir, req):
    c = Ctx(spark, sf_dir)
    links = c.article_tags() if S.wanted_tags(req.tags) else None
    tagger = lambda rows: C.classify(rows, c.rules(), c.topics(), c.gates(), method="broadcast")
    df = S.page_rows(c.articles(), c.journals(), links, c.tags(), req, tagger=tagger)
    return df.select("uid", "doi", "journal_id", "title", "abstract", "article_type", "oa_status", "journal_name",
                     "publisher", ts_text("published_at").alias("published"), "tag_ids", "tag_labels", "safe_url", "page")


REQ_LATEST = S.SearchRequest(oa_status="closed", page=3, page_size=25)
_LATEST = "(a.published_at IS NULL) ASC, a.published_at DESC, a.uid DESC"


@query("search_page_latest", "G-1, G-3, E-3", _page_sql("a.oa_status = 'closed'", _LATEST.replace("a.", ""), 3, 25))
def search_page_latest(spark, sf_dir):
    return _page(spark, sf_dir, REQ_LATEST)


REQ_OLDEST = S.SearchRequest(sort="oldest", date_from="2024-01-03", page=2, page_size=20)
_OLDEST = "(published_at IS NULL) ASC, published_at ASC, uid ASC"


@query("search_page_oldest", "G-2, G-3",
       _page_sql("CAST(a.published_at AS DATE) >= DATE '2024-01-03'", _OLDEST, 2, 20))
def search_page_oldest(spark, sf_dir):
    return _page(spark, sf_dir, REQ_OLDEST)


REQ_LAST_PAGE = S.SearchRequest(query="Eaux", page=99)


@query("search_page_clamped", "G-3 (page past the end -> last page)",
       _page_sql(f"contains(translate({_SEARCH_TEXT}, {_ASCII}), translate('Eaux', {_ASCII}))", _LATEST.replace("a.", ""), 99, 20))
def search_page_clamped(spark, sf_dir):
    return _page(spark, sf_dir, REQ_LAST_PAGE)


REQ_TOTAL = S.SearchRequest(query="the", article_type="review")


@query("search_total", "E-2", with_views(
    f"SELECT count(*) AS total FROM v_articles a JOIN v_journals j ON j.id = a.journal_id "
    f"WHERE contains(translate({_SEARCH_TEXT}, {_ASCII}), 'the') AND a.article_type = 'review'",
    "v_articles", "v_journals"))
def search_total(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return S.total_count(c.articles(), c.journals(), None, REQ_TOTAL)


@query("article_tag_strings", "E-3, D-5", with_views("""
SELECT a.uid, s.tag_ids, s.tag_labels FROM v_articles a LEFT JOIN (
  SELECT l.article_uid AS uid, string_agg(t.id, '|||' ORDER BY t.id) AS tag_ids,
         string_agg(t.label, '|||' ORDER BY t.id) AS tag_labels
  FROM q_article_tags l JOIN v_tags t ON t.id = l.tag_id GROUP BY l.article_uid) s ON s.uid = a.uid""",
    "v_tags", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def article_tag_strings(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return c.articles().select("uid").join(S.tag_strings(c.article_tags(), c.tags()), "uid", "left")


@query("facet_options", "E-1", with_views("""
SELECT facet, id, name, row_number() OVER (PARTITION BY facet ORDER BY name, id) AS ord FROM (
  SELECT 'journal' AS facet, id, name FROM v_journals WHERE enabled
  UNION ALL SELECT DISTINCT 'publisher', publisher, publisher FROM v_journals WHERE enabled
  UNION ALL SELECT 'tag', id, label FROM v_tags
  UNION ALL SELECT DISTINCT 'article_type', article_type, article_type FROM v_articles
  UNION ALL SELECT DISTINCT 'oa_status', oa_status, oa_status FROM v_articles)""", "v_journals", "v_tags", "v_articles"))
def facet_options(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return S.facet_options(c.articles(), c.journals(), c.tags())


@query("classify_ungated", "C-10, D-7", with_views(
    "SELECT h.uid, h.topic_id FROM q_hits h JOIN v_topics t USING (topic_id) WHERE NOT t.gated",
    *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def classify_ungated(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    hits = C.keyword_hits(C.match_fields(c.articles()), c.rules(), "broadcast")
    ungated = c.topics().where(~F.col("gated")).select("topic_id")
    return hits.join(ungated, "topic_id", "left_semi").select("uid", "topic_id")


@query("classify_gated", "D-8", with_views("SELECT article_uid, tag_id FROM q_article_tags",
                                          *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def classify_gated(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return C.classify(c.articles(), c.rules(), c.topics(), c.gates(), method="literal")


@query("classify_ngram_join", "D-7 (token-anchor equi-join)", with_views(
    "SELECT article_uid, tag_id FROM q_article_tags", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def classify_ngram_join(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return C.classify(c.articles(), c.rules(), c.topics(), c.gates(), method="tokens")


@query("classification_summary", "E-7", with_views("""
SELECT (SELECT count(*) FROM v_articles) AS articles_scanned,
  (SELECT count(DISTINCT article_uid) FROM q_article_tags) AS articles_tagged,
  (SELECT count(*) FROM q_article_tags) AS tag_assignments,
  (SELECT count(DISTINCT tag_id) FROM q_article_tags) AS active_tags""", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def classification_summary(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return C.classification_summary(c.articles(), c.article_tags())


REQ_KEYSET = S.SearchRequest(oa_status="closed", page_size=25)


@query("search_keyset_page", "G-1, G-3 (keyset page after a cursor)", _sql_listing(
    "a.oa_status = 'closed' AND (a.published_at IS NULL OR a.published_at < TIMESTAMP '2024-01-10 00:00:00' "
    "OR (a.published_at = TIMESTAMP '2024-01-10 00:00:00' AND a.uid < 'doc:649')) "
    "ORDER BY (a.published_at IS NULL) ASC, a.published_at DESC, a.uid DESC LIMIT 25"))
def search_keyset_page(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    rows = S.page_after(c.articles(), c.journals(), None, REQ_KEYSET, "2024-01-10 00:00:00", "doc:649")
    return _listing(rows)
