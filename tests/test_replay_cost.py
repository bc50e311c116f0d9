"""What a run of the stream does no more than once: small months in one file, replayed items uncleaned, texts read once for outcomes."""

import glob
import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_merge_fold import history  # noqa: E402
from test_stream_rules import Run, body  # noqa: E402

from litfeed.constants import ABSTRACT_PLACEHOLDERS  # noqa: E402
from litfeed.functions.articles import KNOWN  # noqa: E402
from litfeed.functions.text import placeholder_key  # noqa: E402
from litfeed.operators import snapshot as SN  # noqa: E402
from litfeed.sources import feeds as FD  # noqa: E402


def test_small_months_are_one_file_and_large_ones_are_cut(spark, tmp_path, monkeypatch):
    rows = spark.range(1200).select(F.concat(F.lit("u"), "id").alias("uid"),
                                    F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 12) * 2_678_400).alias("published_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        SN._write(rows, "articles", f"{tmp_path}/a")
        months = glob.glob(f"{tmp_path}/a/published_month=*")
        assert len(glob.glob(f"{tmp_path}/a/*/*.parquet")) == len(months) == 12
        monkeypatch.setattr(SN, "FILE_ROWS", 20)
        SN._write(rows, "articles", f"{tmp_path}/b")
        assert len(glob.glob(f"{tmp_path}/b/*/*.parquet")) > 12
        assert spark.read.parquet(f"{tmp_path}/b").count() == 1200
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_replayed_items_are_not_cleaned_again_but_their_errors_count(spark, tmp_path, monkeypatch):
    run, cleaned, real = Run(spark, tmp_path), [], FD.canonicalize
    monkeypatch.setattr(FD, "canonicalize", lambda items, journals: cleaned.append(items.count()) or real(items, journals))
    items = [("One", "a", None), ("Two", "b", None)]
    run.batch(body("j1", 1, items))
    assert run.batch(body("j1", 1, items))["no_change"]
    run.batch(body("j1", 1, items), body("j2", 2, [("Three", "c", None)]))
    assert cleaned == [2, 0, 1]
    assert run.rows("articles", "title") == [("One",), ("Three",), ("Two",)]
    # a body that comes again under another address is refused item by item, as before
    other = body("j1", 1, items)
    assert run.batch((other[0], "https://ex.org/other", *other[2:]))["no_change"]
    assert run.rows("quarantine", "seq", "item_index", "error_class") == [(1, 0, "FeedMismatchError"), (1, 1, "FeedMismatchError")]


def test_long_texts_are_known_without_their_key_and_placeholders_are_not(spark):
    texts = ["N/A" + "." * 500, " n - a ", "NO ABSTRACT", "no abstract today", "x" * 200, "?" * 300, "", None, "ﬃ" * 12, "Unknown\tAbstract!",
             "İ" * 20, "no abstract available" + " " * 50, "Ünknown abstract that goes on"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    key = placeholder_key(F.col("t"))
    plain = F.coalesce(F.col("t").isNotNull() & (key != "") & ~key.isin(*ABSTRACT_PLACEHOLDERS), F.lit(False))
    rows = d.select("t", KNOWN["abstract"](F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and {r.a for r in rows} == {True, False}


def test_outcomes_read_the_texts_once(spark, monkeypatch):
    import random

    from litfeed.operators import identity as I
    from litfeed.operators import outcomes as O
    items = [dict(i) for i in history(random.Random(3), 1)]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    d = spark.createDataFrame([(i["seq"], i["url"], i["doi"], i["journal"], i["title"], i["oa_status"], i["enr"], i["status"]) for i in items],
                              "seq long, url string, doi string, journal_id string, title string, oa_status string, enriched boolean, metadata_status string")
    from litfeed.session import checkpoint_dir
    checkpoint_dir(spark)
    resolved = I.resolve(d).checkpoint(eager=True)
    got = O.outcomes(resolved.mapInArrow(passed, resolved.schema), ("title", "oa_status"))
    assert got.count() == len(items) and seen.value == len(items)
