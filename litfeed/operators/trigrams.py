"""Substring search over a written trigram index (C-1).

``build`` writes the searched text of each article, folded as the scan folds it, in ``blocks`` folders by a hash of the uid, and
postings (trigram, block): which blocks have a text with that trigram. ``search`` takes the blocks that have all trigrams of the wanted
text, a list of at most ``blocks`` numbers, reads only their folders, and verifies the text itself, so the result is the scan's.
A text of fewer than three characters has no trigram: all blocks are read. Postings are sorted by trigram, so a lookup reads the row
groups of its few trigrams. The number of blocks sets how finely rare texts prune; a trigram has at most one posting a block, whatever
the number of articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litfeed.functions.binding import let
from litfeed.functions.text import ascii_lower
from litfeed.operators.search import search_text

BLOCKS = 256


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    runs = lambda chars: F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.array_distinct(F.array_compact(let(F.filter(F.split(text, ""), lambda c: c != ""), runs)))


def build(articles: DataFrame, path: str, blocks: int = BLOCKS) -> None:
    """Write the index of ``articles(uid, title, abstract, doi)`` to the folder ``path``."""
    spark = articles.sparkSession
    texts = articles.select("uid", ascii_lower(search_text(articles)).alias("folded"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"))
    texts.repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/texts")
    stored = spark.read.schema("uid string, folded string, block int").parquet(f"{path}/texts")
    postings = stored.select(F.explode(trigrams(F.col("folded"))).alias("gram"), "block").distinct()
    postings.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")


def candidate_blocks(spark: SparkSession, path: str, wanted: str) -> list[int] | None:
    """The blocks that have every trigram of ``wanted`` (None: all)."""
    grams = sorted({wanted[i:i + 3] for i in range(len(wanted) - 2)})
    if not grams:
        return None
    found = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(grams)).groupBy("block").count().where(F.col("count") == len(grams))
    return [r["block"] for r in found.select("block").collect()]


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(uid) of the articles whose title, abstract or DOI contains ``query``, ASCII letters of either case."""
    wanted = "".join(c.lower() if "A" <= c <= "Z" else c for c in query)
    texts = spark.read.schema("uid string, folded string, block int").parquet(f"{path}/texts")
    blocks = candidate_blocks(spark, path, wanted)
    if blocks is not None:
        texts = texts.where(F.col("block").isin(blocks))
    return texts.where(F.contains("folded", F.lit(wanted))).select("uid")
