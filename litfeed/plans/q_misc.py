"""Catalogue, provenance, ledger and stored-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litfeed.constants import ABSTRACT_PLACEHOLDERS, TITLE_PLACEHOLDERS
from litfeed.operators import classify as C
from litfeed.operators import records as RC
from litfeed.operators import runs as R
from litfeed.operators import tags as T
from litfeed.plans.common import CLASSIFY_VIEWS, SQL_CLASSIFY, Ctx, sql_ts, ts_text
from litfeed.plans.oracle_views import with_views
from litfeed.plans.q_enrich import SQL_RECORDS, _known
from litfeed.plans.q_runs import _O, _RUNS_SQL
from litfeed.plans.registry import query
from litfeed.sources import standins


@query("catalog_by_publisher", "E-13, C-7", with_views(
    "SELECT publisher, count(*) AS n_feeds FROM v_journals WHERE enabled GROUP BY publisher", "v_journals"))
def catalog_by_publisher(spark, sf_dir):
    return Ctx(spark, sf_dir).journals().where("enabled").groupBy("publisher").agg(F.count(F.lit(1)).alias("n_feeds"))


@query("catalog_by_group", "E-13", with_views("""
SELECT g.id AS group_id, g.label, g.ord, count(DISTINCT t.topic_id) AS n_topics,
  string_agg(DISTINCT t.topic_id, ',' ORDER BY t.topic_id) AS topic_ids, count(DISTINCT l.article_uid) AS n_articles, count(l.article_uid) AS n_links
FROM v_groups g LEFT JOIN v_topics t ON t.group_id = g.id LEFT JOIN q_article_tags l ON l.tag_id = t.topic_id
GROUP BY g.id, g.label, g.ord""", *CLASSIFY_VIEWS, "v_groups", extra=SQL_CLASSIFY))
def catalog_by_group(spark, sf_dir):
    """The catalogue's groups with their topics, and the articles that carry one of these."""
    c = Ctx(spark, sf_dir)
    t, g, links = c.topics(), c.groups(), c.article_tags()
    # links are counted by topic and article-group before they meet the (small) catalogue
    n_links = links.groupBy(F.col("tag_id").alias("topic_id")).agg(F.count(F.lit(1)).alias("links"))
    n_articles = links.join(t.select(F.col("topic_id").alias("tag_id"), "group_id"), "tag_id").groupBy("group_id").agg(
        F.count_distinct("article_uid").alias("n_articles"))
    j = g.join(t.join(n_links, "topic_id", "left"), t.group_id == g.id, "left").groupBy(g.id.alias("group_id"), g.label, g.ord).agg(
        F.count("topic_id").alias("n_topics"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.array_join(F.array_sort(F.collect_list("topic_id")), ",").alias("topic_ids"))
    return j.join(n_articles, "group_id", "left").select(
        "group_id", "label", "ord", "n_topics", F.when(F.col("n_topics") > 0, F.col("topic_ids")).alias("topic_ids"),
        F.coalesce("n_articles", F.lit(0)).alias("n_articles"), "n_links")


_OLD_TAGS = "SELECT CASE WHEN id IN ('t03', 't04') THEN 'old-' || id ELSE id END AS id, label FROM v_tags"


@query("label_conflicts", "E-14", with_views(f"""
SELECT 'id_with_labels' AS kind, id AS key, count(DISTINCT label) AS n FROM q_all GROUP BY id HAVING count(DISTINCT label) > 1
UNION ALL SELECT 'label_with_ids', label, count(DISTINCT id) FROM q_all GROUP BY label HAVING count(DISTINCT id) > 1""",
    "v_tags", extra={"q_all": f"SELECT id, label FROM v_tags UNION ALL {_OLD_TAGS} UNION ALL SELECT id, label || ' (renamed)' FROM v_tags WHERE id = 't01' UNION ALL SELECT source, lang FROM documents"}))
def label_conflicts(spark, sf_dir):
    """The catalogue with moved and renamed tags, and the documents' own labels: languages under their sources."""
    c = Ctx(spark, sf_dir)
    t = c.tags()
    moved = t.withColumn("id", F.when(F.col("id").isin("t03", "t04"), F.concat(F.lit("old-"), "id")).otherwise(F.col("id")))
    renamed = t.where(F.col("id") == "t01").withColumn("label", F.concat("label", F.lit(" (renamed)")))
    given = c.table("documents").select(F.col("source").alias("id"), F.col("lang").alias("label"))
    allt = t.unionByName(moved).unionByName(renamed).unionByName(given).select(F.col("id").alias("topic_id"), "label")
    return C.label_conflicts(allt).select("kind", "key", "n")


_STORED = {**SQL_RECORDS, "q_stored": """
SELECT seq, title, abstract, oa_status, metadata_status,
  CASE WHEN seq % 13 = 0 THEN 'not json' WHEN seq % 17 = 0 THEN '{"a": 1}' ELSE to_json(authors)::VARCHAR END AS authors_json,
  CASE WHEN seq % 19 = 0 THEN '["title", "colour"]' WHEN seq % 23 = 0 THEN '"title"'
       ELSE to_json(enriched_fields || CASE WHEN seq % 8 = 0 THEN ['abstract'] ELSE [] END)::VARCHAR END AS enriched_fields_json
FROM q_records"""}


def _stored(spark, sf_dir):
    r = standins.item_records(spark, sf_dir)
    s = F.col("seq")
    prov = F.concat("enriched_fields", F.when(s % 8 == 0, F.array(F.lit("abstract"))).otherwise(F.array().cast("array<string>")))
    return r.select("seq", "title", "abstract", "oa_status", "metadata_status",
                    F.when(s % 13 == 0, F.lit("not json")).when(s % 17 == 0, F.lit('{"a": 1}'))
                    .otherwise(F.to_json("authors")).alias("authors_json"),
                    F.when(s % 19 == 0, F.lit('["title", "colour"]')).when(s % 23 == 0, F.lit('"title"'))
                    .otherwise(F.to_json(prov)).alias("enriched_fields_json"))


@query("stored_row_rejects", "A-10, B-20", with_views("""
SELECT seq, reason FROM (SELECT seq, CASE
  WHEN NOT json_valid(authors_json) THEN 'authors_not_json'
  WHEN json_type(CASE WHEN json_valid(authors_json) THEN authors_json ELSE 'null' END) <> 'ARRAY' THEN 'authors_not_list'
  WHEN NOT json_valid(enriched_fields_json) THEN 'provenance_not_json'
  WHEN json_type(CASE WHEN json_valid(enriched_fields_json) THEN enriched_fields_json ELSE 'null' END) <> 'ARRAY' THEN 'provenance_not_list'
  WHEN len(list_filter(CAST(CASE WHEN json_valid(enriched_fields_json) AND json_type(enriched_fields_json) = 'ARRAY' THEN enriched_fields_json ELSE '[]' END AS VARCHAR[]),
           lambda f: f NOT IN ('title', 'authors', 'abstract', 'published_at', 'article_type', 'oa_status'))) > 0 THEN 'provenance_unknown_field'
  END AS reason FROM q_stored) WHERE reason IS NOT NULL""", "v_items", extra=_STORED))
def stored_row_rejects(spark, sf_dir):
    Ctx(spark, sf_dir)
    d = RC.decode_stored(_stored(spark, sf_dir))
    return d.where(F.col("reject_reason").isNotNull()).select("seq", F.col("reject_reason").alias("reason"))


@query("provenance_check", "H-10, Q-9", with_views(f"""
SELECT seq, 'title' AS field FROM q_prov WHERE list_contains(ef, 'title') AND NOT {_known('title', TITLE_PLACEHOLDERS)}
UNION ALL SELECT seq, 'abstract' FROM q_prov WHERE list_contains(ef, 'abstract') AND NOT {_known('abstract', ABSTRACT_PLACEHOLDERS)}
UNION ALL SELECT seq, 'oa_status' FROM q_prov WHERE list_contains(ef, 'oa_status') AND NOT coalesce(oa_status IN ('open', 'closed'), false)""",
    "v_items", extra={**_STORED, "q_prov": """
SELECT *, CAST(CASE WHEN json_type(ej) = 'ARRAY' THEN ej ELSE '[]' END AS VARCHAR[]) AS ef
FROM (SELECT *, CASE WHEN json_valid(enriched_fields_json) THEN enriched_fields_json ELSE 'null' END AS ej FROM q_stored)
WHERE json_type(ej) = 'ARRAY'"""}))
def provenance_check(spark, sf_dir):
    Ctx(spark, sf_dir)
    d = RC.decode_stored(_stored(spark, sf_dir)).where(F.col("enriched_fields").isNotNull())
    return RC.provenance_violations(d.select("seq", "title", "abstract", "oa_status", "enriched_fields"))


@query("provenance_backfill", "H-11", with_views(f"""
SELECT seq, array_to_string(CASE WHEN metadata_status IN ('partial', 'enriched') THEN list_filter([
    CASE WHEN {_known('title', TITLE_PLACEHOLDERS)} THEN 'title' END,
    CASE WHEN {_known('abstract', ABSTRACT_PLACEHOLDERS)} THEN 'abstract' END,
    CASE WHEN coalesce(oa_status IN ('open', 'closed'), false) THEN 'oa_status' END], lambda x: x IS NOT NULL)
  ELSE enriched_fields END, ',') AS enriched_fields
FROM q_records""", "v_items", extra=SQL_RECORDS))
def provenance_backfill(spark, sf_dir):
    r = standins.item_records(spark, sf_dir).select("seq", "title", "abstract", "oa_status", "metadata_status", "enriched_fields")
    return RC.backfill_provenance(r).select("seq", F.array_join("enriched_fields", ",").alias("enriched_fields"))


@query("replace_article_tags", "H-7", with_views("""
SELECT article_uid, tag_id FROM q_article_tags l WHERE NOT EXISTS (SELECT 1 FROM v_articles a WHERE a.uid = l.article_uid AND a.journal_id = 'src3')
UNION SELECT uid, 't01' FROM v_articles WHERE journal_id = 'src3'""", *CLASSIFY_VIEWS, extra=SQL_CLASSIFY))
def replace_article_tags(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    target = c.articles().where(F.col("journal_id") == "src3").select("uid")
    new = target.select(F.col("uid").alias("article_uid"), F.lit("t01").alias("tag_id"))
    return T.replace_one(c.article_tags(), target, new)


@query("catalog_checks", "A-5, A-6, Q-7, Q-8", with_views("""
SELECT 'feed_duplicate_id' AS "check", count(*) AS violations FROM (SELECT id FROM q_feeds GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'feed_duplicate_url', count(*) FROM (SELECT lower(feed_url) FROM q_feeds GROUP BY lower(feed_url) HAVING count(*) > 1)
UNION ALL SELECT 'feed_not_https', count(*) FROM q_feeds WHERE NOT starts_with(lower(trim(feed_url)), 'https://')
UNION ALL SELECT 'feed_bad_url', count(*) FROM q_feeds WHERE NOT regexp_matches(feed_url, '^https?://[a-z0-9.-]+/')
UNION ALL SELECT 'feed_unknown_publisher', count(*) FROM q_feeds WHERE lower(publisher) NOT IN ('aaas', 'aip', 'aps', 'elsevier', 'ieee', 'nature', 'springer', 'wiley')
UNION ALL SELECT 'feed_enabled_not_boolean', count(*) FROM q_feeds WHERE enabled IS NULL
UNION ALL SELECT 'group_order_not_continuous', count(*) FROM (SELECT min(ord) AS lo, max(ord) AS hi, count(*) AS n, count(DISTINCT ord) AS d FROM v_groups) WHERE lo <> 1 OR hi <> n OR d <> n
UNION ALL SELECT 'group_empty', count(*) FROM v_groups g WHERE NOT EXISTS (SELECT 1 FROM v_topics t WHERE t.group_id = g.id)
UNION ALL SELECT 'topic_unknown_group', count(*) FROM v_topics t WHERE NOT EXISTS (SELECT 1 FROM v_groups g WHERE g.id = t.group_id)
UNION ALL SELECT 'topic_without_keyword', count(*) FROM v_topics t WHERE NOT EXISTS (SELECT 1 FROM v_rules r WHERE r.topic_id = t.topic_id)
UNION ALL SELECT 'keyword_duplicate', count(*) FROM (SELECT lower(keyword) FROM v_rules GROUP BY lower(keyword) HAVING count(*) > 1)
UNION ALL SELECT 'gate_unknown_group', count(*) FROM v_gates g WHERE NOT EXISTS (SELECT 1 FROM v_groups x WHERE x.id = g.required_group)
UNION ALL SELECT 'gate_own_group', count(*) FROM v_gates g JOIN v_topics t USING (topic_id) WHERE g.required_group = t.group_id""",
    "v_journals", "v_groups", "v_topics", "v_rules", "v_gates", extra={"q_feeds": """
SELECT id, name, publisher, feed_url, enabled FROM v_journals
UNION ALL SELECT id, name, publisher, replace(feed_url, 'https://', 'http://'), enabled FROM v_journals WHERE id IN ('src3', 'src4')
UNION ALL SELECT id || '-copy', name, 'acme', feed_url, enabled FROM v_journals WHERE id = 'src5'"""}))
def catalog_checks(spark, sf_dir):
    """Feed catalogue = journals plus rule-based bad entries (http duplicates, a copied URL, unknown publisher)."""
    from litfeed.operators import catalogs as K
    c = Ctx(spark, sf_dir)
    j = c.journals().select("id", "name", "publisher", "feed_url", "enabled")
    bad = (j.where(F.col("id").isin("src3", "src4")).withColumn("feed_url", F.replace("feed_url", F.lit("https://"), F.lit("http://")))
           .unionByName(j.where(F.col("id") == "src5").withColumn("id", F.concat("id", F.lit("-copy"))).withColumn("publisher", F.lit("acme"))))
    feeds = j.unionByName(bad)
    return K.feed_checks(feeds).unionByName(K.topic_checks(c.groups(), c.topics(), c.rules(), c.gates()))


@query("article_lookup", "A-7, A-8", with_views(f"""
SELECT uid, journal_id, title, {sql_ts('published_at')} AS published_at FROM v_articles WHERE uid = 'doc:42'""", "v_articles"))
def article_lookup(spark, sf_dir):
    a = Ctx(spark, sf_dir).articles()
    return a.where(F.col("uid") == F.lit("doc:42")).select("uid", "journal_id", "title", ts_text("published_at").alias("published_at"))
