"""Rules of the incremental run: nothing is lost, conflicts are set aside, catalogue changes retag, disabled feeds stay out."""

import uuid

from litfeed.operators import snapshot as SN
from litfeed.sources import catalog
from litfeed.sources import feeds as FD
from litfeed.streaming.incremental import run_stream


def body(feed, seq, items, broken=False, flag=False):
    text = "".join(f"<item><title>{t}</title><link>https://ex.org/{u}</link>" + (f"<guid>{d}</guid>" if d else "") + "</item>" for t, u, d in items)
    xml = f'<?xml version="1.0"?><rss version="2.0"><channel><title>T</title><link>https://ex.org/</link><description>D</description>{text}'
    return (feed, f"https://ex.org/{feed}", None, (xml + ("</channel></rss>" if not broken else "")).encode() if not broken else b"<html>",
            None, None, flag, seq)


class Run:
    def __init__(self, spark, tmp_path, feeds=("j1", "j2"), off=()):
        self.spark, self.work, self.n = spark, str(tmp_path / uuid.uuid4().hex), 0
        self.journals = spark.createDataFrame([(f, f, "aps", f"https://ex.org/{f}", f not in off) for f in feeds],
                                              "id string, name string, publisher string, feed_url string, enabled boolean")
        self.cat = (catalog.rules_df(spark), catalog.topics_df(spark), catalog.gates_df(spark))

    def batch(self, *bodies):
        self.spark.createDataFrame(list(bodies), FD.RAW_FEEDS_SCHEMA).write.parquet(f"{self.work}/landing/p={self.n}")
        self.n += 1
        return run_stream(self.spark, f"{self.work}/landing", f"{self.work}/snap", f"{self.work}/ckpt", self.journals, *self.cat)[-1]

    def rows(self, name, *cols):
        return sorted(tuple(r) for r in SN.open_snapshot(self.spark, f"{self.work}/snap", name).select(*cols).collect())


def test_a_refused_batch_is_not_lost(spark, tmp_path):
    run = Run(spark, tmp_path)
    assert run.batch(body("j1", 1, [("One", "a", None)]))["published"]
    # a batch whose only body is broken ends with status error, so the gate refuses it
    bad = run.batch(body("j1", 2, [], broken=True))
    assert not bad["published"]
    assert run.rows("articles", "title") == [("One",)]
    assert run.batch(body("j1", 3, [("Two", "b", None)]))["published"]
    assert run.rows("articles", "title") == [("One",), ("Two",)]
    assert run.rows("quarantine", "seq", "error_class") == [(2, "FeedParseError")]
    assert [r[0] for r in run.rows("runs", "run_id")] == [1, 2, 3]


def test_conflicts_are_set_aside_and_aliases_stay_unique(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.batch(body("j1", 1, [("A", "1", "10.1000/a"), ("B", "1", "10.1000/b")], flag=None), body("j2", 2, [("C", "2", "10.1000/a")]))
    report = run.batch(body("j2", 3, [("D", "1", None), ("E", "3", "10.1000/c")]))
    assert report["published"] and not report["violations"]
    assert run.rows("articles", "doi", "journal_id", "title") == [("10.1000/a", "j1", "A"), ("10.1000/c", "j2", "E")]
    assert [u for u, _ in run.rows("url_aliases", "normalized_url", "article_uid")] == ["https://ex.org/1", "https://ex.org/3"]
    assert run.rows("quarantine", "journal_id", "seq", "item_index") == [("j1", 1, 1), ("j2", 2, 0), ("j2", 3, 0)]


def test_disabled_feeds_are_not_taken_in(spark, tmp_path):
    run = Run(spark, tmp_path, off=("j2",))
    run.batch(body("j1", 1, [("One", "a", None)]), body("j2", 2, [("Two", "b", None)]))
    assert run.rows("articles", "title") == [("One",)]


def test_another_catalogue_tags_every_article_anew(spark, tmp_path):
    run = Run(spark, tmp_path)
    rule = lambda topic, word: (
        spark.createDataFrame([(topic, topic, "g", False, word)], "topic_id string, label string, group_id string, gated boolean, keyword string"),
        spark.createDataFrame([(topic, topic, "g", False)], "topic_id string, label string, group_id string, gated boolean"),
        spark.createDataFrame([], "topic_id string, required_group string"))
    run.cat = rule("t1", "alpha")
    run.batch(body("j1", 1, [("alpha beta", "a", None)]))
    assert run.rows("article_tags", "tag_id") == [("t1",)]
    run.cat = rule("t2", "beta")
    assert run.batch(body("j1", 2, [("gamma", "c", None)]))["published"]
    assert run.rows("article_tags", "tag_id") == [("t2",)] and run.rows("tags", "id") == [("t2",)]
