"""Run accounting, feed state, quality gate and tag maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litfeed.operators import feedstate as FS
from litfeed.operators import gate as G
from litfeed.operators import runs as R
from litfeed.operators import tags as T
from litfeed.plans.common import CLASSIFY_VIEWS, SQL_CLASSIFY, Ctx, sql_ts, ts_text
from litfeed.plans.oracle_views import with_views
from litfeed.plans.registry import query

_OUTCOME = """CASE WHEN status = 'error' THEN 'error' WHEN status = 'not_modified' THEN 'not_modified'
  WHEN item_errors > 0 THEN 'partial' ELSE 'ok' END"""
_O = {"q_o": f"SELECT *, {_OUTCOME} AS outcome FROM v_fetches"}


@query("feed_status_by_feed", "E-9", with_views("""
SELECT feed_id, count(*) AS n_checks, count(*) FILTER (WHERE outcome = 'ok') AS n_ok,
  count(*) FILTER (WHERE outcome = 'not_modified') AS n_not_modified, count(*) FILTER (WHERE outcome = 'partial') AS n_partial,
  count(*) FILTER (WHERE outcome = 'error') AS n_error, CAST(sum(item_errors) AS BIGINT) AS item_errors, arg_max(outcome, seq) AS last_outcome
FROM q_o GROUP BY feed_id""", "v_fetches", extra=_O))
def feed_status_by_feed(spark, sf_dir):
    return R.feed_status_by_feed(Ctx(spark, sf_dir).fetches())


_RUNS_SQL = """
SELECT run_id, feeds_checked, successful_feeds, failed_feeds, item_failures, item_failures + failed_feeds AS failed,
  CASE WHEN feeds_checked = 0 THEN 'error' WHEN successful_feeds = 0 THEN 'error'
       WHEN item_failures + failed_feeds > 0 THEN 'partial' ELSE 'ok' END AS status
FROM (SELECT run_id, count(*) AS feeds_checked, count(*) FILTER (WHERE outcome <> 'error') AS successful_feeds,
        count(*) FILTER (WHERE outcome = 'error') AS failed_feeds,
        CAST(sum(CASE WHEN outcome <> 'error' THEN item_errors ELSE 0 END) AS BIGINT) AS item_failures
      FROM q_o GROUP BY run_id)"""


@query("run_outcome_summary", "E-4, E-5", with_views(_RUNS_SQL, "v_fetches", extra=_O))
def run_outcome_summary(spark, sf_dir):
    return R.run_summary(Ctx(spark, sf_dir).fetches())


@query("latest_run", "F-4", with_views("SELECT * FROM q_runs ORDER BY run_id DESC LIMIT 1", "v_fetches",
                                      extra={**_O, "q_runs": _RUNS_SQL}))
def latest_run(spark, sf_dir):
    return R.latest_run(R.run_summary(Ctx(spark, sf_dir).fetches()))


_ERRS = {**_O, "q_e": """
SELECT run_id, seq, substring(feed_id, 1, 128) AS feed_id, i AS item_index, 'ItemError' AS error
FROM q_o, range(0, item_errors) t(i) WHERE item_errors > 0"""}


@query("run_notes_top_errors", "E-6, F-5", with_views("""
SELECT r.run_id, r.rn, r.feed_id, r.item_index, r.error, c.omitted_item_errors
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq, item_index) AS rn FROM q_e) r
JOIN (SELECT run_id, greatest(count(*) - 20, 0) AS omitted_item_errors FROM q_e GROUP BY run_id) c USING (run_id)
WHERE r.rn <= 20""", "v_fetches", extra=_ERRS))
def run_notes_top_errors(spark, sf_dir):
    return R.run_notes(Ctx(spark, sf_dir).fetches())


@query("run_feed_lists", "E-6", with_views("""
SELECT r.run_id, r.kind, r.rn, substring(r.feed_id, 1, 128) AS feed_id, c.omitted
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY seq) AS rn FROM q_k) r
JOIN (SELECT run_id, kind, greatest(count(*) - 100, 0) AS omitted FROM q_k GROUP BY run_id, kind) c USING (run_id, kind)
WHERE r.rn <= 100""", "v_fetches",
    extra={**_O, "q_k": "SELECT *, CASE WHEN outcome = 'error' THEN 'failed' ELSE 'successful' END AS kind FROM q_o"}))
def run_feed_lists(spark, sf_dir):
    return R.run_feed_lists(Ctx(spark, sf_dir).fetches())


_SETS_E = "(status = 'ok' OR etag IS NOT NULL)"
_SETS_L = "(status = 'ok' OR last_modified IS NOT NULL)"
_OK = "status IN ('ok', 'not_modified')"


@query("feed_state_final", "F-2", with_views(f"""
SELECT feed_id,
  (arg_max({{'v': etag}}, seq) FILTER (WHERE {_SETS_E})).v AS etag,
  (arg_max({{'v': last_modified}}, seq) FILTER (WHERE {_SETS_L})).v AS last_modified,
  {sql_ts('arg_max(checked_at, seq)')} AS last_checked_at,
  {sql_ts(f'max(checked_at) FILTER (WHERE {_OK})')} AS last_success_at,
  arg_max(status, seq) AS last_status,
  (arg_max({{'v': CASE WHEN {_OK} THEN NULL ELSE error END}}, seq)).v AS last_error
FROM v_fetches GROUP BY feed_id""", "v_fetches"))
def feed_state_final(spark, sf_dir):
    s = FS.final_state(Ctx(spark, sf_dir).fetches())
    return s.withColumn("last_checked_at", ts_text("last_checked_at")).withColumn("last_success_at", ts_text("last_success_at"))


@query("feed_state_history", "F-2 (window form, chunked carry)", with_views(f"""
SELECT feed_id, seq,
  (last_value(CASE WHEN {_SETS_E} THEN {{'v': etag}} END IGNORE NULLS) OVER w).v AS etag,
  (last_value(CASE WHEN {_SETS_L} THEN {{'v': last_modified}} END IGNORE NULLS) OVER w).v AS last_modified,
  {sql_ts('checked_at')} AS last_checked_at,
  {sql_ts(f'last_value(CASE WHEN {_OK} THEN checked_at END IGNORE NULLS) OVER w')} AS last_success_at,
  status AS last_status, CASE WHEN {_OK} THEN NULL ELSE error END AS last_error
FROM v_fetches WINDOW w AS (PARTITION BY feed_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "v_fetches"))
def feed_state_history(spark, sf_dir):
    # small chunk so that even the test scale splits each feed over several chunks
    h = FS.state_history(Ctx(spark, sf_dir).fetches(), chunk=512)
    return h.withColumn("last_checked_at", ts_text("last_checked_at")).withColumn("last_success_at", ts_text("last_success_at"))


@query("quality_report", "E-8, Q-1, Q-3..Q-6", with_views(f"""
SELECT count(*) AS article_count, (SELECT count(*) FROM v_journals) AS journal_count,
  {sql_ts('min(a.published_at)')} AS min_published_at, {sql_ts('max(a.published_at)')} AS max_published_at,
  count(*) FILTER (WHERE NOT (a.article_type IN ('research','review','editorial','correction','other')
                   AND a.oa_status IN ('open','closed','unknown'))) AS enum_violations,
  count(*) FILTER (WHERE a.uid IS NULL OR a.title IS NULL OR a.journal_id IS NULL) AS null_violations,
  count(*) FILTER (WHERE j.id IS NULL) AS orphan_articles,
  (SELECT count(*) - count(DISTINCT uid) FROM v_articles) AS duplicate_uids,
  (SELECT count(doi) - count(DISTINCT doi) FROM v_articles) AS duplicate_dois,
  (SELECT status FROM q_runs ORDER BY run_id DESC LIMIT 1) AS latest_run_status,
  count(*) > 0 AND count(*) FILTER (WHERE NOT (a.article_type IN ('research','review','editorial','correction','other')
                   AND a.oa_status IN ('open','closed','unknown'))) = 0
    AND count(*) FILTER (WHERE a.uid IS NULL OR a.title IS NULL OR a.journal_id IS NULL) = 0
    AND count(*) FILTER (WHERE j.id IS NULL) = 0
    AND (SELECT count(*) - count(DISTINCT uid) FROM v_articles) = 0
    AND (SELECT count(doi) - count(DISTINCT doi) FROM v_articles) = 0
    AND (SELECT status FROM q_runs ORDER BY run_id DESC LIMIT 1) IN ('ok', 'partial') AS passed
FROM v_articles a LEFT JOIN v_journals j ON j.id = a.journal_id""", "v_articles", "v_journals", "v_fetches",
    extra={**_O, "q_runs": _RUNS_SQL}))
def quality_report(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    r = G.quality_report(c.articles(), c.journals(), R.run_summary(c.fetches()))
    return r.withColumn("min_published_at", ts_text("min_published_at")).withColumn("max_published_at", ts_text("max_published_at"))


@query("orphans", "D-11, Q-1", with_views("""
SELECT 'article_journal' AS fk, count(*) AS violations FROM v_articles a WHERE a.journal_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM v_journals j WHERE j.id = a.journal_id)
UNION ALL SELECT 'item_journal', count(*) FROM v_items_conflict i WHERE i.journal_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM v_journals j WHERE j.id = i.journal_id)
UNION ALL SELECT 'link_article', count(*) FROM q_article_tags l WHERE NOT EXISTS (SELECT 1 FROM v_articles a WHERE a.uid = l.article_uid)
UNION ALL SELECT 'link_tag', count(*) FROM q_article_tags l WHERE NOT EXISTS (SELECT 1 FROM v_tags t WHERE t.id = l.tag_id)""",
    "v_journals", "v_items_conflict", "v_tags", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def orphans(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    links = c.article_tags()
    return G.orphans([
        ("article_journal", c.articles(), "journal_id", c.journals(), "id"),
        ("item_journal", c.items(conflict=True), "journal_id", c.journals(), "id"),
        ("link_article", links, "article_uid", c.articles(), "uid"),
        ("link_tag", links, "tag_id", c.tags(), "id"),
    ])


@query("duplicate_keys", "E-12, Q-6", with_views("""
SELECT 'title' AS key_type, lower(title) AS key, count(*) AS n FROM v_articles WHERE title IS NOT NULL GROUP BY lower(title) HAVING count(*) > 1
UNION ALL SELECT 'item_url', url, count(*) FROM v_items GROUP BY url HAVING count(*) > 1""", "v_articles", "v_items"))
def duplicate_keys(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return G.duplicate_keys([("title", c.articles().select(F.lower("title").alias("k")), "k"),
                             ("item_url", c.items(), "url")])


@query("count_drop_gate", "Q-10", with_views("""
SELECT p.previous_count, c.candidate_count, (p.previous_count = 0 OR c.candidate_count >= p.previous_count * 0.5) AS passed
FROM (SELECT count(*) AS previous_count FROM v_articles) p, (SELECT count(*) AS candidate_count FROM v_articles WHERE oa_status <> 'unknown') c""",
    "v_articles"))
def count_drop_gate(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    a = c.articles()
    return G.count_drop(a, a.where(F.col("oa_status") != "unknown"))


@query("active_tags", "D-6", with_views("SELECT * FROM v_tags t WHERE EXISTS (SELECT 1 FROM q_article_tags l WHERE l.tag_id = t.id)",
                                       "v_tags", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def active_tags(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return T.active_tags(c.tags(), c.article_tags())


@query("unused_tags", "D-6", with_views("SELECT * FROM v_tags t WHERE NOT EXISTS (SELECT 1 FROM q_article_tags l WHERE l.tag_id = t.id)",
                                       "v_tags", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def unused_tags(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return T.unused_tags(c.tags(), c.article_tags())


_MOVED = ("t03", "t04")


@query("tag_label_migration", "H-6", with_views("""
SELECT DISTINCT l.article_uid, coalesce(n.id, l.tag_id) AS tag_id
FROM q_old_links l LEFT JOIN (SELECT o.id AS old_id, n.id FROM q_old_tags o JOIN v_tags n ON n.label = o.label AND n.id <> o.id) n
  ON n.old_id = l.tag_id""", "v_tags", *CLASSIFY_VIEWS, extra={
    **SQL_CLASSIFY,
    "q_old_tags": "SELECT CASE WHEN id IN ('t03', 't04') THEN 'old-' || id ELSE id END AS id, label FROM v_tags",
    "q_old_links": "SELECT article_uid, CASE WHEN tag_id IN ('t03', 't04') THEN 'old-' || tag_id ELSE tag_id END AS tag_id FROM q_article_tags"}))
def tag_label_migration(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    rename = lambda col: F.when(F.col(col).isin(*_MOVED), F.concat(F.lit("old-"), F.col(col))).otherwise(F.col(col))
    old_tags = c.tags().withColumn("id", rename("id"))
    old_links = c.article_tags().withColumn("tag_id", rename("tag_id"))
    return T.migrate_labels(old_tags, old_links, c.tags())


@query("assignment_set_diff", "H-2, D-12", with_views("""
SELECT coalesce(s.uid, a.uid) AS uid, CASE WHEN s.uid IS NULL THEN 'unknown' ELSE 'omitted' END AS side
FROM (SELECT DISTINCT uid FROM v_articles) s FULL OUTER JOIN (SELECT DISTINCT article_uid AS uid FROM q_article_tags) a ON a.uid = s.uid
WHERE s.uid IS NULL OR a.uid IS NULL""", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def assignment_set_diff(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return T.assignment_set_diff(c.articles(), c.article_tags().select(F.col("article_uid").alias("uid")))
