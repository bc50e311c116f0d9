"""Incremental update as Structured Streaming (rows-only check)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litfeed.operators import snapshot as SN
from litfeed.plans.common import Ctx, ts_text
from litfeed.plans.registry import query
from litfeed.session import Scratch, delete, released_shuffles
from litfeed.sources import standins
from litfeed.streaming.incremental import run_stream


def replay_run(spark, sf_dir, split: bool = True):
    """Land bodies in two time-ordered batches plus a replay of the first; run the
    stream after each landing. Returns (root, reports)."""
    c = Ctx(spark, sf_dir)
    work = Scratch(spark, "litfeed-stream").path
    landing, root, ckpt = f"{work}/landing", f"{work}/snapshots", f"{work}/stream-checkpoint"
    reports = []
    with Scratch(spark, "litfeed-bodies") as scratch, released_shuffles(spark):
        raw = scratch.keep(standins.raw_feeds(spark, sf_dir), "raw")  # made once, reused for every part
        cut = raw.agg(F.percentile_approx("seq", 0.5).alias("m")).first().m if split else None
        parts = [raw.where(F.col("seq") <= cut), raw.where(F.col("seq") > cut), raw.where(F.col("seq") <= cut)] if split else [raw]
        for i, part in enumerate(parts):
            part.write.mode("overwrite").option("compression", "zstd").parquet(f"{landing}/landing_batch={i}")
            reports += run_stream(spark, landing, root, ckpt, c.journals(), c.rules(), c.topics(), c.gates())
            delete(spark, f"{landing}/landing_batch={i}")  # taken in: the stream's log knows its files
    return root, reports


@query("incremental_replay", "J-1, J-2, J-4, J-5, A-14..A-16, G-P")
def incremental_replay(spark, sf_dir):
    root, _ = replay_run(spark, sf_dir)
    arts = SN.open_snapshot(spark, root, "articles")
    return arts.select("uid", "doi", "journal_id", "title", ts_text("published_at").alias("published_at"),
                       "article_type", "metadata_status")
