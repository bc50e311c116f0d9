"""Physical plan shapes the design relies on."""

from pyspark.sql import functions as F

from litfeed.operators import classify as C
from litfeed.operators import runs as R
from litfeed.operators import search as S
from litfeed.operators import snapshot as SN
from litfeed.plans.common import Ctx
from litfeed.sources import standins

SF_SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_literal_classifier_neither_joins_nor_shuffles_hits(spark):
    c = Ctx(spark, SF_SMALL)
    # more files than cores: nothing is dealt out before the text work either
    arts = c.articles().sparkSession.createDataFrame([("a", "laser", None)], "uid string, title string, abstract string")
    p = _plan(C.classify(arts, c.rules(), c.topics(), c.gates(), method="literal"))
    assert "Join" not in p and "Exchange" not in p and "Window" not in p


def test_top_errors_limit_before_shuffle(spark):
    p = _plan(R.run_notes(standins.fetches(spark, SF_SMALL)))
    assert "WindowGroupLimit" in p


def test_snapshot_date_filter_prunes_months(spark, tmp_path):
    arts = (standins.articles(spark, SF_SMALL).withColumn("authors", F.array().cast("array<string>"))
            .withColumn("normalized_url", F.col("article_url")).withColumn("source_feed_url", F.lit("f"))
            .withColumn("metadata_status", F.lit("rss_only")).withColumn("enriched_fields", F.array().cast("array<string>"))
            .withColumn("first_seen_at", F.col("published_at")).withColumn("last_updated_at", F.col("published_at")))
    root = str(tmp_path)
    base = SN.write_snapshot({"articles": arts}, root, 1)
    SN.publish(spark, root, base)
    snap = SN.open_snapshot(spark, root)
    req = S.SearchRequest(date_from="2024-01-02", date_to="2024-01-02")
    df = S.filtered(snap, standins.journals(spark, SF_SMALL), None, req)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "published_month" in p and "PartitionFilters: [isnotnull(published_month" in p
    assert df.count() == S.filtered(standins.articles(spark, SF_SMALL), standins.journals(spark, SF_SMALL), None, req).count()
