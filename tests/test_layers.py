"""Layered snapshots (G-P): bytes follow the change, readers see one version, layers stay few; counters and times of the run."""

import os
import random
import sys
from datetime import UTC, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_merge_fold import fold_outcomes, history  # noqa: E402
from test_stream_rules import Run, body  # noqa: E402

from litfeed.operators import snapshot as SN  # noqa: E402
from litfeed.session import checkpoint_dir  # noqa: E402
from litfeed.streaming import incremental as INC  # noqa: E402


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_a_change_of_one_percent_writes_about_one_percent(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda n, mark: spark.range(n).select(
        F.concat(F.lit("u"), F.col("id")).alias("uid"), F.sha2(F.concat(F.lit(mark), F.col("id")), 512).alias("title"),
        F.repeat(F.sha2(F.concat(F.col("id"), F.lit(mark)), 512), 4).alias("abstract"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("published_at"))
    one = SN.write_snapshot({"articles": rows(20_000, "a"), "journals": spark.range(3)}, root, 1)
    new = rows(20_000, "b").where("pmod(xxhash64(uid), 100) = 0")  # one percent, all over the keys
    two = SN.write_snapshot({"articles": SN.Change(new, "uid", new.select("uid"))}, root, 2, parent=one)
    assert size(f"{root}/snapshot=2") < 0.03 * size(f"{root}/snapshot=1")
    old, now = (SN.read_table(spark, b, "articles") for b in (one, two))
    assert old.count() == now.count() == 20_000 and old.join(now, ["uid", "title"], "left_anti").count() == new.count()
    assert SN.read_table(spark, two, "journals").count() == 3
    # the months of a date filter are still pruned, in each layer
    SN.publish(spark, root, two)
    plan = SN.read_table(spark, two, "articles", keep_partition=True).where("published_month = '2023-11'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [isnotnull(published_month") == 2 and plan.count() == 20_000


def test_layers_equal_a_dictionary_and_stay_few(spark, tmp_path):
    rnd, root, base, model = random.Random(5), str(tmp_path), None, {}
    versions = []
    for run in range(1, 15):
        keys = rnd.sample(range(60), rnd.choice((0, 1, 2, 5, 30)))
        gone = [k for k in keys if k in model]
        new = {k: run for k in keys if rnd.random() < 0.8}  # some keys go and are not written again
        model = {k: v for k, v in model.items() if k not in gone} | new
        rows = spark.createDataFrame(list(new.items()), "normalized_url long, article_uid long")
        dropped = spark.createDataFrame([(k,) for k in gone], "normalized_url long")
        base = SN.write_snapshot({"url_aliases": SN.Change(rows, "normalized_url", dropped)}, root, run, parent=base)
        versions.append((base, dict(model)))
        layers = SN.table_places(spark, base)["url_aliases"]["layers"]
        assert all(a["rows"] > SN.GROWTH * b["rows"] for a, b in zip(layers, layers[1:])) and len(layers) <= 6
    for at, want in versions[::3] + versions[-1:]:
        assert {tuple(r) for r in SN.read_table(spark, at, "url_aliases").collect()} == set(want.items())


def stream_items(spark, items, batch):
    rows = [(Decimal(batch) * INC.BATCH_SPAN + i["seq"], i["url"], i["doi"], i["journal"], i["title"], i["oa_status"], i["enr"], i["status"])
            for i in items]
    d = spark.createDataFrame(rows, f"seq {INC.WIDE}, url string, doi string, journal_id string, title string, oa_status string, "
                                    "enr boolean, metadata_status string")
    null = lambda kind: F.lit(None).cast(kind)
    d = d.withColumns({"abstract": null("string"), "authors": F.array().cast("array<string>"), "published_at": null("timestamp"),
                       "article_type": F.lit("other"), "article_url": F.col("url"), "source_feed_url": F.lit("f"), "is_alias": F.lit(False),
                       "stored_uid": null("string"), "first_seen_at": null("timestamp"), "last_updated_at": null("timestamp")})
    return d.withColumns({f"{f}_enr": F.col("enr") if f in ("title", "oa_status") else F.lit(False) for f in INC.FIELDS}).drop("enr")


def test_outcomes_and_times_over_random_splits_equal_one_item_after_the_other(spark, tmp_path):
    checkpoint_dir(spark)
    rnd = random.Random(23)
    hists = [history(rnd, k) for k in range(120)]
    want = {s: o for hs in hists for s, o in fold_outcomes(hs).items()}
    cuts = [rnd.randint(0, len(hs)) for hs in hists]
    arts = aliases = None
    got, t0 = {}, datetime(2026, 1, 1, tzinfo=UTC)
    for batch in (0, 1):
        part = [i for hs, c in zip(hists, cuts) for i in (hs[:c] if batch == 0 else hs[c:])]
        done = INC.upsert(arts, aliases, stream_items(spark, part, batch), batch, t0 + timedelta(hours=batch))
        got |= {int(r["seq"] - Decimal(batch) * INC.BATCH_SPAN): r["outcome"] for r in done.outcomes.collect()}
        arts, aliases = done.articles(arts).checkpoint(eager=True), done.url_aliases(aliases).checkpoint(eager=True)
    bad = [(s, got.get(s), o) for s, o in want.items() if got.get(s) != o]
    assert not bad, bad[:10]
    # times: first seen in the first batch unless all its items came later; last updated with the last item that changed it
    for r in arts.select("uid", "first_seen_at", "last_updated_at", "normalized_url").collect():
        k = int(r["normalized_url"].split("/")[2][1:])
        hs, c = hists[k], cuts[k]
        if c == 0 or c == len(hs):
            assert r["first_seen_at"] == r["last_updated_at"]
        assert r["first_seen_at"] <= r["last_updated_at"]


def test_counters_times_and_links_of_runs(spark, tmp_path):
    run = Run(spark, tmp_path)
    times = iter(datetime(2026, 3, d, tzinfo=UTC) for d in (1, 2, 3))
    real = INC.run_stream

    def at_times(*a, **b):
        return real(*a, **b, clock=lambda: next(times))
    import test_stream_rules
    test_stream_rules.run_stream = at_times
    try:
        run.batch(body("j1", 1, [("One", "a", None), ("Two", "b", "10.1000/b")]))
        report = run.batch(body("j1", 2, [("One", "a", None), ("Two, corrected", "b", "10.1000/b"), ("Three", "c", None)]),
                           body("j2", 3, [("Clash", "d", "10.1000/b")]))
        assert report["published"]
    finally:
        test_stream_rules.run_stream = real
    assert run.rows("runs", "run_id", "inserted", "updated", "skipped", "failed", "status") == [
        (1, 2, 0, 0, 0, "ok"), (2, 1, 1, 1, 1, "partial")]
    day = lambda t: t.day
    assert [(t, day(a), day(b)) for t, a, b in run.rows("articles", "title", "first_seen_at", "last_updated_at")] == [
        ("One", 1, 1), ("Three", 2, 2), ("Two, corrected", 1, 2)]
    assert run.rows("feed_state", "feed_id", "last_status") == [("j1", "ok"), ("j2", "partial")]


def test_links_of_merged_rows_meet_at_the_survivor(spark):
    checkpoint_dir(spark)
    item = lambda seq, url, doi: dict(seq=seq, url=url, doi=doi, journal="j", title="T", oa_status="open", enr=False, status="rss_only")
    first = INC.upsert(None, None, stream_items(spark, [item(1, "u1", "10.1/a"), item(2, "u2", None)], 0), 0, datetime(2026, 1, 1))
    arts, aliases = first.folded, first.aliases.checkpoint(eager=True)
    uid = {r["normalized_url"]: r["uid"] for r in arts.collect()}
    links = spark.createDataFrame([(uid["u1"], "x"), (uid["u1"], "y"), (uid["u2"], "y"), (uid["u2"], "z")], "article_uid string, tag_id string")
    done = INC.upsert(arts, aliases, stream_items(spark, [item(3, "u2", "10.1/a")], 1), 1, datetime(2026, 1, 2))
    assert sorted(tuple(r) for r in done.links(links).collect()) == [(uid["u1"], t) for t in "xyz"]
    assert [r["outcome"] for r in done.outcomes.collect()] == ["updated"]
    assert done.articles(arts).count() == 1
