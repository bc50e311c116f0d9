"""What the stream leaves on disk: texts are never checkpointed, scratch tables and shuffle files go when they were used."""

import os
import random
import sys
import time

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_stream_rules import Run, body  # noqa: E402

from litfeed.functions.articles import KNOWN  # noqa: E402
from litfeed.operators import merge as M  # noqa: E402
from litfeed.plans.q_stream import replay_run  # noqa: E402
from litfeed.session import checkpoint_dir, released_shuffles  # noqa: E402
from litfeed.streaming import incremental as INC  # noqa: E402

TEXTS = {"content", "summary", "abstract"}


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_replay_checkpoints_no_text_and_leaves_no_scratch(spark, tmp_path, monkeypatch):
    rows = [(i, f"Title {i}\nSome text of document {i}", f"src{1 + i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/t/documents.parquet")
    top = checkpoint_dir(spark).removeprefix("file:")
    before, kept, real = set(os.listdir(top)), [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, eager=True: kept.append(dict(self.dtypes)) or real(self, eager))
    root, reports = replay_run(spark, f"{tmp_path}/t", split=False)
    assert len(reports) == 1 and reports[0]["published"] and reports[0]["article_count"] > 0
    assert kept and not [c for c in kept if any(c.get(t) in ("string", "binary") for t in TEXTS)]  # digests of texts are short
    new = {d for d in set(os.listdir(top)) - before if d.startswith("litfeed-")}
    assert new == {root.removeprefix("file:").removeprefix(f"{top.rstrip('/')}/").split("/")[0]}
    assert os.listdir(f"{top}/{new.pop()}/landing") == []


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    d = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    with released_shuffles(spark):
        before = shuffle_files(spark)
        d.write.parquet(f"{tmp_path}/n")
        until = time.time() + 20
        while shuffle_files(spark) > before and time.time() < until:
            time.sleep(0.2)
        assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert spark.read.parquet(f"{tmp_path}/n").count() == 700


def test_items_that_came_twice_in_a_batch_count_once(spark, tmp_path):
    rows = [("j", 1, 0, None, 5), ("j", 1, 0, None, 3), ("j", 1, 0, "UnusableUrlError", 1), ("j", None, 0, None, 8), ("j", None, 0, None, 9), ("k", 1, 0, None, 2)]
    events = spark.createDataFrame(rows, "journal_id string, seq long, item_index int, error_class string, _row long").withColumn("title", F.col("_row").cast("string"))
    assert sorted(r.title for r in INC.unrepeated(events).collect()) == ["2", "3", "8"]
    run = Run(spark, tmp_path)
    twice = body("j1", 1, [("One", "a", None), ("Two", "b", None)])
    assert run.batch(twice, twice)["article_count"] == 2
    # a batch of old and new items together takes in the new ones
    assert run.batch(twice, body("j2", 2, [("Three", "c", None)]))["article_count"] == 3
    assert run.rows("runs", "run_id", "items_applied") == [(1, 2), (2, 1)]


def test_merge_sends_one_value_a_field(spark):
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(60)}", rng.choice([0, 0, -2, -5]), s if s % 31 else None, rng.choice(["N/A", "Untitled", None, "A", "B", "C"]),
             rng.random() < 0.3, rng.random() < 0.1) for s in range(150)]
    resolved = spark.createDataFrame(rows, "entity string, phase long, seq long, title string, enriched boolean, is_alias boolean").withColumns(
        {c: F.lit("x") for c in ("uid", "doi", "journal_id", "url", "metadata_status")})
    merged = M.merge(resolved, ("title",))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by(") + plan.count("min_by(") == 3  # the field, journal and url
    # the three terms of the rule, each on its own
    v, real = F.struct(F.col("title").alias("v")), ~F.col("is_alias")
    known, key = KNOWN["title"](F.col("title")) & real, F.struct("phase", "seq")
    terms = [F.max_by(F.when(c, v), F.when(c, key)) for c in (F.col("enriched") & known, known)]
    own = (F.col("phase") == 0) & real
    three = resolved.groupBy("entity").agg(F.coalesce(*terms, F.min_by(F.when(own, v), F.when(own, F.col("seq"))))["v"].alias("want"))
    got = merged.join(three, "entity").select("title", "want").collect()
    assert len(got) == len({r[0] for r in rows}) and all(r.title == r.want for r in got) and {r.title for r in got} >= {"A", "N/A"}
