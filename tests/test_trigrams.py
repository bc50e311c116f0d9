"""Trigram index: the rows of the scan for any text, and only the blocks that can have it."""

import random
import re

from pyspark.sql import functions as F

from litfeed.functions.text import ascii_lower
from litfeed.operators import search as S
from litfeed.operators import trigrams as G

SF_SMALL = "/root/testdata/sf0.001"


def test_same_rows_as_the_scan_from_fewer_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = [(f"u{r['doc_id']}", r["text"][:40], r["text"], None) for r in docs.collect()]
    texts += [("null", None, None, None), ("blank", "", "", ""), ("emoji", "a🙂b🙂c", "x" * 200_000 + "needle" + "y" * 200_000, "10.1/Ab"), ("É", "ÉTÉ École", "", None)]
    arts = spark.createDataFrame(texts, "uid string, title string, abstract string, doi string").cache()
    path = str(tmp_path / "index")
    G.build(arts, path, blocks=64)
    rnd = random.Random(4)
    queries = ["needle", "🙂b🙂", "10.1/aB", "École", "école", "ab", "", "never said by anyone", "xy"]
    for _ in range(12):
        t = rnd.choice(texts[:-4])[2]
        at = rnd.randrange(max(1, len(t) - 12))
        queries.append(t[at:at + rnd.randint(1, 12)].swapcase())
    for q in queries:
        want = {r["uid"] for r in arts.where(F.contains(ascii_lower(S.search_text(arts)), ascii_lower(F.lit(q)))).collect()}
        assert {r["uid"] for r in G.search(spark, path, q).collect()} == want, q
    assert G.candidate_blocks(spark, path, "ab") is None and G.candidate_blocks(spark, path, "never said by anyone") == []
    few = G.candidate_blocks(spark, path, "needle")
    plan = G.search(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert 1 <= len(few) < 16 and re.search(r"PartitionFilters: \[[^]]*block#", plan)


def test_postings_are_one_a_block(spark, tmp_path):
    arts = spark.range(500).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit("same text").alias("title"), F.lit("").alias("abstract"), F.lit("").alias("doi"))
    G.build(arts, str(tmp_path / "index"), blocks=8)
    post = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert post.count() == post.distinct().count() <= 8 * len("same text  ")
    assert G.search(spark, str(tmp_path / "index"), "E TEX").count() == 500
