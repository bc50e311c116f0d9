"""Public surface: upsert in two steps equals one step; search returns rows and total."""

from pyspark.sql import functions as F

from litfeed import api
from litfeed.plans.common import Ctx
from litfeed.sources import standins

SF_SMALL = "/root/testdata/sf0.001"


def test_upsert_two_steps_equal_one(spark):
    c = Ctx(spark, SF_SMALL)
    events = api.canonicalize(api.ingest(standins.raw_feeds(spark, SF_SMALL)), c.journals()) \
        .where(F.col("error_class").isNull())
    first, second = events.where("seq <= 12"), events.where("seq > 12")
    a1, al1 = api.upsert(None, None, first, 0)
    a2, _ = api.upsert(a1.checkpoint(eager=True), al1.checkpoint(eager=True), second, 1)
    one, _ = api.upsert(None, None, events, 0)
    cols = ["uid", "doi", "title", "normalized_url", "metadata_status"]
    assert sorted(map(tuple, a2.select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))
    rows, total = api.search(c.articles(), c.journals(), c.article_tags(), c.tags(), query="the", page=2, page_size=5)
    assert total > 5 and rows.count() == 5
