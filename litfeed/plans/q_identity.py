"""Identity, merge and conflict queries over the item history stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from litfeed.functions.articles import short_sha256
from litfeed.operators import identity as I
from litfeed.operators import merge as M
from litfeed.operators import outcomes as O
from litfeed.operators import records as RC
from litfeed.operators import runs as R
from litfeed.operators import tags as T
from litfeed.plans.common import Ctx, sql_casefold, sql_ts, ts_text
from litfeed.plans.oracle_views import with_views
from litfeed.plans.registry import query
from litfeed.sources.standins import read

SQL_ID = {
    "q_url": """
SELECT url, arg_min(doi, seq) FILTER (WHERE doi IS NOT NULL) AS url_doi, min(seq) FILTER (WHERE doi IS NOT NULL) AS link_seq,
  min(seq) AS url_first_seq FROM v_items GROUP BY url""",
    "q_keyed": """
SELECT i.*, u.url_doi, u.link_seq, u.url_first_seq, coalesce(i.doi, u.url_doi, 'url:' || i.url) AS entity
FROM v_items i LEFT JOIN q_url u ON u.url = i.url""",
    "q_ent": """
SELECT entity, max(doi) AS doi, arg_min(url, seq) FILTER (WHERE doi IS NOT NULL) AS f_url,
  arg_min(url_first_seq, seq) FILTER (WHERE doi IS NOT NULL) AS f_first, min(seq) FILTER (WHERE doi IS NOT NULL) AS f_seq,
  arg_min(url, seq) AS first_url, count(*) AS n_items, count(DISTINCT url) AS n_urls, min(seq) AS first_seq
FROM q_keyed GROUP BY entity""",
    "q_surv": """
SELECT *, CASE WHEN doi IS NULL THEN 'url:' || left(sha256(first_url), 24)
  WHEN f_first < f_seq THEN 'url:' || left(sha256(f_url), 24) ELSE 'doi:' || doi END AS uid FROM q_ent""",
}


@query("identity_entities", "D-1", with_views("SELECT seq, entity FROM q_keyed", "v_items", extra=SQL_ID))
def identity_entities(spark, sf_dir):
    return I.with_entity(Ctx(spark, sf_dir).items()).select("seq", "entity")


@query("survivor_uid", "D-1, §2.1", with_views(
    "SELECT entity, uid, doi, f_url, n_items, n_urls, first_seq FROM q_surv", "v_items", extra=SQL_ID))
def survivor_uid(spark, sf_dir):
    k = I.with_entity(Ctx(spark, sf_dir).items())
    return I.entities(k).select("entity", "uid", "doi", "f_url", "n_items", "n_urls", "first_seq")


@query("alias_table", "H-1, F-3", with_views(
    "SELECT DISTINCT k.url AS normalized_url, s.uid AS article_uid FROM q_keyed k JOIN q_surv s ON s.entity = k.entity",
    "v_items", extra=SQL_ID))
def alias_table(spark, sf_dir):
    return I.alias_table(Ctx(spark, sf_dir).items())


_PH = {**SQL_ID, "q_ph": """
SELECT k.*, s.uid, CASE WHEN k.link_seq IS NOT NULL AND k.url <> s.f_url AND k.seq < k.link_seq THEN -k.link_seq ELSE 0 END AS phase
FROM q_keyed k JOIN q_surv s ON s.entity = k.entity""", "q_ord": """
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY phase, seq) AS ord FROM q_ph"""}

_TITLE_NA = "('na', 'no title', 'not available', 'title unavailable', 'unknown', 'untitled')"
_ABSTRACT_NA = ("('abstract unavailable', 'na', 'no abstract', 'no abstract available', 'not available', 'unknown', "
                "'unknown abstract')")


def _known_sql(f: str, col: str | None = None) -> str:
    """Meaningful-value predicate of field ``f`` evaluated on column ``col`` (default: the field itself)."""
    c = col or f
    if f == "title":
        return f"coalesce({c} IS NOT NULL AND {_key(c)} <> '' AND {_key(c)} NOT IN {_TITLE_NA}, false)"
    if f == "abstract":
        return f"coalesce({c} IS NOT NULL AND {_key(c)} <> '' AND {_key(c)} NOT IN {_ABSTRACT_NA}, false)"
    if f == "published_at":
        return f"{c} IS NOT NULL"
    if f == "article_type":
        return f"coalesce(trim({c}) <> '' AND lower({c}) <> 'other', false)"
    return f"coalesce({c} IN ('open', 'closed'), false)"


def _key(x):
    return f"trim(regexp_replace(regexp_replace({sql_casefold(x)}, '\\p{{P}}', '', 'g'), '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\p{{Z}}]+', ' ', 'g'))"


def _merge_sql():
    cols = []
    for f in M.MERGED_FIELDS:
        known = _known_sql(f)
        val = sql_ts(f) if f == "published_at" else f
        cols.append(f"""coalesce((arg_max({{'v': {val}}}, ord) FILTER (WHERE enriched AND {known})).v,
  (arg_max({{'v': {val}}}, ord) FILTER (WHERE {known})).v, (arg_min({{'v': {val}}}, seq) FILTER (WHERE phase = 0)).v) AS {f},
  coalesce(bool_or(enriched AND {known}), false) AS {f}_enriched""")
    flags = " || ".join(f"CASE WHEN {f}_enriched THEN ['{f}'] ELSE [] END" for f in
                        ("title", "abstract", "published_at", "article_type", "oa_status"))
    return f"""
SELECT entity, uid, doi, title, title_enriched, abstract, abstract_enriched, published_at, published_at_enriched,
  article_type, article_type_enriched, oa_status, oa_status_enriched, journal_id, normalized_url, metadata_status,
  first_seq, last_seq, n_items, array_to_string({flags}, ',') AS enriched_fields
FROM (SELECT entity, max(uid) AS uid, max(doi) AS doi, {', '.join(cols)},
  arg_max(journal_id, seq) AS journal_id, arg_max(url, seq) AS normalized_url,
  CASE max(CASE metadata_status WHEN 'rss_only' THEN 0 WHEN 'partial' THEN 1 WHEN 'enriched' THEN 2 END)
    WHEN 0 THEN 'rss_only' WHEN 1 THEN 'partial' WHEN 2 THEN 'enriched' END AS metadata_status,
  min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_items
FROM q_ord GROUP BY entity)"""


@query("merge_fields", "E-10, E-11, B-18", with_views(_merge_sql(), "v_items", extra=_PH))
def merge_fields(spark, sf_dir):
    m = M.merge(I.resolve(Ctx(spark, sf_dir).items()))
    return m.select("entity", "uid", "doi", "title", "title_enriched", "abstract", "abstract_enriched",
                    ts_text("published_at").alias("published_at"), "published_at_enriched", "article_type",
                    "article_type_enriched", "oa_status", "oa_status_enriched", "journal_id", "normalized_url",
                    "metadata_status", "first_seq", "last_seq", "n_items",
                    F.array_join("enriched_fields", ",").alias("enriched_fields"))


@query("conflict_keys", "H-9", with_views("""
SELECT 'url_dois' AS key_type, url AS key, count(DISTINCT doi) AS n FROM v_items_conflict WHERE doi IS NOT NULL GROUP BY url HAVING count(DISTINCT doi) > 1
UNION ALL SELECT 'doi_journals', doi, count(DISTINCT journal_id) FROM v_items_conflict WHERE doi IS NOT NULL AND journal_id IS NOT NULL GROUP BY doi HAVING count(DISTINCT journal_id) > 1
UNION ALL SELECT 'url_journals', url, count(DISTINCT journal_id) FROM v_items_conflict WHERE journal_id IS NOT NULL GROUP BY url HAVING count(DISTINCT journal_id) > 1""",
    "v_items_conflict"))
def conflict_keys(spark, sf_dir):
    return I.conflict_keys(Ctx(spark, sf_dir).items(conflict=True))


def _outcome_sql(select: str | None = None, *views: str, more: dict[str, str] | None = None):
    """``select``: a query over ``q_out`` (seq, entity, lifetime, outcome), the outcomes themselves by default."""
    fields = M.MERGED_FIELDS
    kn = {f: _known_sql(f) for f in fields}
    val = {f: (sql_ts(f) if f == "published_at" else f) for f in fields}
    base_cols = ", ".join(f"{kn[f]} AS k_{f}, enriched AND {kn[f]} AS e_{f}, {val[f]} AS v_{f}" for f in fields)
    fin = ", ".join(
        f"coalesce((arg_max({{'v': v_{f}}}, seq) FILTER (WHERE e_{f})).v, (arg_max({{'v': v_{f}}}, seq) FILTER (WHERE k_{f})).v, "
        f"(arg_min({{'v': v_{f}}}, seq)).v) AS fin_{f}, bool_or(e_{f}) AS fenr_{f}" for f in fields)
    ent = ", ".join(
        f"arg_min({{'t': link, 'v': fin_{f}}}, link) FILTER (WHERE fenr_{f}) AS a_e_{f}, "
        f"arg_min({{'t': link, 'v': fin_{f}}}, link) FILTER (WHERE {_known_sql(f, 'fin_' + f)}) AS a_k_{f}, "
        f"min(link) FILTER (WHERE fenr_{f}) AS a_flag_{f}" for f in fields)
    w = "OVER (PARTITION BY lifetime ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    carries = ", ".join(
        f"last_value(CASE WHEN e_{f} THEN {{'v': v_{f}}} END IGNORE NULLS) {w} AS c_le_{f}, "
        f"last_value(CASE WHEN k_{f} THEN {{'v': v_{f}}} END IGNORE NULLS) {w} AS c_lk_{f}" for f in fields)
    vis = lambda c: f"(phase = 0 AND {c} IS NOT NULL AND {c} <= seq)"
    state_parts = ["'doi': c_doi", "'journal_id': journal_id", "'url': url",
                   f"'rank': CASE WHEN c_r2 OR {vis('a_r2')} THEN 2 WHEN c_r1 OR {vis('a_r1')} THEN 1 ELSE 0 END"]
    for f in fields:
        state_parts.append(
            f"'{f}': coalesce(c_le_{f}.v, CASE WHEN {vis(f'a_e_{f}.t')} THEN a_e_{f}.v END, c_lk_{f}.v, "
            f"CASE WHEN {vis(f'a_k_{f}.t')} THEN a_k_{f}.v END, f_{f})")
        state_parts.append(f"'{f}_enr': (c_le_{f} IS NOT NULL OR {vis(f'a_flag_{f}')})")
    firsts = ", ".join(f"(arg_min({{'v': v_{f}}}, seq)).v AS f_{f}" for f in fields)
    extra = dict(_PH)
    extra["q_b"] = f"""
SELECT *, entity || '|' || CASE WHEN phase = 0 THEN 'own' ELSE url END AS lifetime,
  CASE metadata_status WHEN 'rss_only' THEN 0 WHEN 'partial' THEN 1 WHEN 'enriched' THEN 2 END AS rnk, {base_cols}
FROM q_ph"""
    extra["q_fin"] = f"SELECT entity, lifetime, max(-phase) AS link, max(rnk) AS rnk, {fin} FROM q_b WHERE phase < 0 GROUP BY entity, lifetime"
    extra["q_abs"] = f"""
SELECT entity, min(link) FILTER (WHERE rnk >= 2) AS a_r2, min(link) FILTER (WHERE rnk >= 1) AS a_r1, {ent}
FROM q_fin GROUP BY entity"""
    extra["q_first"] = f"SELECT lifetime, min(seq) AS first_seq, {firsts} FROM q_b GROUP BY lifetime"
    extra["q_c"] = f"""
SELECT b.*, {carries},
  last_value(doi IGNORE NULLS) {w} AS c_doi,
  bool_or(rnk >= 2) {w} AS c_r2, bool_or(rnk >= 1) {w} AS c_r1
FROM q_b b"""
    extra["q_s"] = f"""
SELECT c.seq, c.entity, c.lifetime, c.phase, c.url, c.link_seq, c.url_first_seq, s.f_url, fi.first_seq,
  {{{', '.join(state_parts)}}} AS state
FROM q_c c JOIN q_first fi ON fi.lifetime = c.lifetime LEFT JOIN q_abs a ON a.entity = c.entity
JOIN q_surv s ON s.entity = c.entity"""
    body = """
SELECT seq, entity, lifetime, CASE WHEN seq = first_seq THEN 'inserted'
  WHEN phase = 0 AND seq = link_seq AND url <> f_url AND url_first_seq < link_seq THEN 'updated'
  WHEN state IS NOT DISTINCT FROM lag(state) OVER (PARTITION BY lifetime ORDER BY seq) THEN 'skipped'
  ELSE 'updated' END AS outcome
FROM q_s"""
    if select is None:
        return with_views(body, "v_items", extra=extra)
    return with_views(select, "v_items", *views, extra={**extra, "q_out": body, **(more or {})})


def _outcomes(c: Ctx):
    r = I.resolve(c.items())
    return O.outcomes(r.withColumn("published_at", ts_text("published_at")), chunk=256)


@query("upsert_outcomes", "F-1, H-5", _outcome_sql())
def upsert_outcomes(spark, sf_dir):
    return _outcomes(Ctx(spark, sf_dir))


#: The time at which an item is seen, here a minute each, in order.
SEEN_EPOCH = 1_760_000_000


@query("article_change_times", "E-11", _outcome_sql(f"""
SELECT entity, {sql_ts("min(seen)")} AS first_seen_at,
  {sql_ts("arg_max(seen, seq) FILTER (WHERE lifetime = entity || '|own' AND outcome <> 'skipped')")} AS last_updated_at
FROM (SELECT *, TIMESTAMP '1970-01-01' + to_seconds({SEEN_EPOCH} + seq * 60) AS seen FROM q_out) GROUP BY entity"""))
def article_change_times(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    at = c.items().select("seq", F.timestamp_seconds(F.lit(SEEN_EPOCH) + F.col("seq") * 60).alias("at"))
    t = O.change_times(_outcomes(c), at)
    return t.select("entity", *[ts_text(x).alias(x) for x in ("first_seen_at", "last_updated_at")])


_RUN_SQL = {"q_runs": """
SELECT run_id, CASE WHEN ok = 0 THEN 'error' WHEN failed > 0 THEN 'partial' ELSE 'ok' END AS status, failed, started_at, finished_at
FROM (SELECT run_id, count(*) FILTER (status <> 'error') AS ok, min(checked_at) AS started_at, max(checked_at) AS finished_at,
        CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE item_errors END) AS BIGINT) AS failed FROM v_fetches GROUP BY run_id)""",
            "q_of_run": "SELECT outcome, 1 + seq % (SELECT max(run_id) FROM v_fetches) AS run_id FROM q_out"}


@query("run_ledger", "A-13, E-4", _outcome_sql(f"""
SELECT r.run_id AS id, {sql_ts('started_at')} AS started_at, {sql_ts('finished_at')} AS finished_at, status,
  count(*) FILTER (outcome = 'inserted') AS inserted_count, count(*) FILTER (outcome = 'updated') AS updated_count,
  count(*) FILTER (outcome = 'skipped') AS skipped_count, failed AS failed_count
FROM q_runs r LEFT JOIN q_of_run o ON o.run_id = r.run_id GROUP BY r.run_id, started_at, finished_at, status, failed""", "v_fetches", more=_RUN_SQL))
def run_ledger(spark, sf_dir):
    """Items are dealt to the runs in turn."""
    c = Ctx(spark, sf_dir)
    f = c.fetches()
    runs = R.run_summary(f)
    last = f.agg(F.max("run_id")).first()[0]
    found = _outcomes(c).select("outcome", (F.col("seq") % last + 1).alias("run_id"))
    led = RC.run_ledger(runs.unionByName(runs), f, found)  # a replayed run id is kept once
    return led.withColumn("started_at", ts_text("started_at")).withColumn("finished_at", ts_text("finished_at"))


@query("merged_links", "H-3", with_views(f"""
SELECT DISTINCT s.uid AS article_uid, 'src-' || l.journal_id AS tag_id
FROM (SELECT CASE WHEN phase < 0 OR doi IS NULL THEN 'url:' || left(sha256(url), 24) ELSE 'doi:' || doi END AS row_uid, entity, journal_id FROM q_ph) l
JOIN q_surv s ON s.entity = l.entity""", "v_items", extra=_PH))
def merged_links(spark, sf_dir):
    """Each row that ever stood for an item is linked to its journal's tag; links of merged rows are united under the survivor."""
    r = I.resolve(Ctx(spark, sf_dir).items())
    own = F.when((F.col("phase") < 0) | F.col("doi").isNull(), F.concat(F.lit("url:"), short_sha256(F.col("url")))).otherwise(
        F.concat(F.lit("doi:"), "doi"))
    rows = r.select(own.alias("article_uid"), F.concat(F.lit("src-"), "journal_id").alias("tag_id"), F.col("uid").alias("survivor_uid"))
    survivors = rows.select(F.col("article_uid").alias("uid"), "survivor_uid").distinct()
    return T.rekey_links(rows.select("article_uid", "tag_id"), survivors)




def _conflict_sql() -> str:
    """Item after item: what its keys stand for is looked up in two lists, and an accepted item adds its new keys."""
    walk = {"q_said": """
SELECT row_number() OVER (ORDER BY seq) AS n, seq, list_filter([{'k': 'uj:' || url, 'v': journal_id}, {'k': 'dj:' || doi, 'v': journal_id},
  {'k': 'ud:' || url, 'v': doi}], lambda c: c.k IS NOT NULL AND c.v IS NOT NULL) AS cs FROM v_items_conflict""", "q_walk": """
SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, []::VARCHAR[] AS ks, []::VARCHAR[] AS vs, false AS bad
UNION ALL
SELECT n, seq, CASE WHEN bad THEN ks ELSE list_concat(ks, list_transform(fresh, lambda c: c.k)) END,
  CASE WHEN bad THEN vs ELSE list_concat(vs, list_transform(fresh, lambda c: c.v)) END, bad
FROM (SELECT t.n, t.seq, w.ks, w.vs, list_filter(t.cs, lambda c: NOT list_contains(w.ks, c.k)) AS fresh,
        len(list_filter(t.cs, lambda c: list_contains(w.ks, c.k) AND w.vs[list_position(w.ks, c.k)] <> c.v)) > 0 AS bad
      FROM q_walk w JOIN q_said t ON t.n = w.n + 1)""",
            "v_items": "SELECT * FROM v_items_conflict WHERE seq NOT IN (SELECT seq FROM q_walk WHERE bad)"}
    sql = with_views(f"""
SELECT 'article' AS kind, NULL::BIGINT AS seq, uid, doi, journal_id, title, abstract, published_at, article_type, oa_status, NULL AS error_class
FROM ({_merge_sql()})
UNION ALL SELECT 'quarantine', seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'RepositoryConflictError' FROM q_walk WHERE bad""",
                     "v_items_conflict", extra={**walk, **_PH})
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("conflict_resolution", "H-9, §2.3", _conflict_sql())
def conflict_resolution(spark, sf_dir):
    from litfeed.operators.conflicts import resolve_with_conflicts
    arts, quarantine = resolve_with_conflicts(Ctx(spark, sf_dir).items(conflict=True))
    fields = ("uid", "doi", "journal_id", "title", "abstract", "published_at", "article_type", "oa_status")
    q = quarantine.select(F.lit("quarantine").alias("kind"), "seq", *[F.lit(None).cast("string").alias(f) for f in fields], "error_class")
    a = arts.withColumn("published_at", ts_text("published_at")).select(
        F.lit("article").alias("kind"), F.lit(None).cast("long").alias("seq"), *fields, F.lit(None).cast("string").alias("error_class"))
    return a.unionByName(q)


@query("identity_lookup", "D-1 on stored rows: DOI, then alias or own URL, then UID", with_views("""
SELECT seq, uid, array_to_string(list_filter(rest, lambda x: x IS NOT NULL AND x <> uid), ',') AS merges, repairs, conflict
FROM (SELECT i.seq, coalesce(d.uid, a.uid, o.uid, n.uid) AS uid,
    CASE WHEN n.uid = coalesce(a.uid, o.uid) THEN [coalesce(a.uid, o.uid)] ELSE [coalesce(a.uid, o.uid), n.uid] END AS rest,
    a.uid IS NULL AND o.uid IS NOT NULL AS repairs,
    (SELECT count(DISTINCT x) > 1 FROM (SELECT unnest([i.doi, d.doi, coalesce(a.row, o.row).doi, n.doi]) AS x))
      OR coalesce(d.journal_id <> i.journal_id, false) OR coalesce(coalesce(a.row, o.row).journal_id <> i.journal_id, false)
      OR coalesce(n.journal_id <> i.journal_id, false) AS conflict
  FROM q_named i LEFT JOIN v_articles d ON d.doi = i.doi
  LEFT JOIN (SELECT t.normalized_url, v.uid, {'doi': v.doi, 'journal_id': v.journal_id} AS row
             FROM q_alias t JOIN v_articles v ON v.uid = t.article_uid) a ON a.normalized_url = i.url
  LEFT JOIN (SELECT article_url, uid, {'doi': doi, 'journal_id': journal_id} AS row FROM v_articles) o ON o.article_url = i.url
  LEFT JOIN v_articles n ON n.uid = i.named_uid)""", "v_articles", extra={
    "q_alias": """
SELECT article_url AS normalized_url, uid AS article_uid FROM v_articles WHERE CAST(substring(uid, 5) AS BIGINT) % 5 <> 0
UNION ALL SELECT replace(article_url, '/a/', '/old/'), uid FROM v_articles WHERE CAST(substring(uid, 5) AS BIGINT) % 3 = 0""",
    "q_named": """
SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN '10.5555/d' || doc_id END AS doi,
  CASE WHEN doc_id % 2 = 0 THEN 'https://ex.org/a/' || (doc_id + 1) ELSE 'https://ex.org/old/' || doc_id END AS url,
  CASE doc_id % 7 WHEN 0 THEN 'doc:' || (doc_id + 2) WHEN 1 THEN 'doc:' || doc_id END AS named_uid, source AS journal_id
FROM documents"""}))
def identity_lookup(spark, sf_dir):
    """Every document as an incoming item that names stored articles by DOI, by a neighbour's or an older URL, and by UID; the aliases
    of every fifth article are lost."""
    ctx = Ctx(spark, sf_dir)
    articles = ctx.articles().withColumnRenamed("article_url", "normalized_url").select("uid", "doi", "journal_id", "normalized_url")
    n = F.substring("uid", 5, 20).cast("long")
    alias = articles.where(n % 5 != 0).select("normalized_url", F.col("uid").alias("article_uid")).unionByName(
        articles.where(n % 3 == 0).select(F.replace("normalized_url", F.lit("/a/"), F.lit("/old/")).alias("normalized_url"),
                                          F.col("uid").alias("article_uid")))
    d = F.col("doc_id")
    uid = lambda x: F.concat(F.lit("doc:"), x.cast("string"))
    items = read(spark, sf_dir, "documents").select(
        d.alias("seq"), F.when(d % 3 == 0, F.concat(F.lit("10.5555/d"), d.cast("string"))).alias("doi"),
        F.when(d % 2 == 0, F.concat(F.lit("https://ex.org/a/"), (d + 1).cast("string"))).otherwise(
            F.concat(F.lit("https://ex.org/old/"), d.cast("string"))).alias("url"),
        F.when(d % 7 == 0, uid(d + 2)).when(d % 7 == 1, uid(d)).alias("named_uid"), F.col("source").alias("journal_id"))
    return I.lookup(items, articles, alias).select("seq", "uid", F.array_join("merges", ",").alias("merges"), "repairs", "conflict")
