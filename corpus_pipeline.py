"""A training corpus from ``documents``: four stages, each a table that the next one reads.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``; the
last returns one row per packed piece of the documents that the others kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litfeed.llm import decontam, packing, quality, simhash
from litfeed.llm.catalogue import VOCABULARY
from litfeed.llm.common import table, written
from litfeed.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines that failed are cut from the others."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    ship_package(spark)
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in windows."""
    import public_tokenizers
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("packing", pack)]

#: Fingerprints and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
