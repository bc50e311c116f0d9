"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litfeed.session import checkpoint_dir

#: Words of most operators: runs without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(col):
    """The words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE), "")


def let(value, body):
    """``body(value)`` with ``value`` computed once per row. A column that a lambda uses is otherwise put into the
    lambda by the optimizer and computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, lineage cut, readable after an
    executor is lost. A frame without columns in Parquet's sense (no rows) keeps its schema."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, key: str, order: list, name: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: the gapless position from 0 of each row within ``key``, in ``order`` (``weight``: the sum of that
    column over the rows before it); ``total``: the key's number of rows (sum of weights), too.

    A key may hold any share of the rows: rows are range-partitioned by (key, order), written once, and
    numbered within (partition, key); only the counts of these pieces meet per key.
    """
    part, before, whole = fresh(df, "_part"), fresh(df, "_before"), fresh(df, "_whole")
    cut = written(df.repartitionByRange(F.col(key), *order).withColumn(part, F.spark_partition_id()), "ranged")
    pieces = cut.groupBy(key, part).agg((F.sum(weight) if weight else F.count("*")).alias(before))
    up_to = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(whole, F.sum(before).over(Window.partitionBy(key))).withColumn(
        before, F.coalesce(F.sum(before).over(up_to), F.lit(0)))
    rows = Window.partitionBy(key, part).orderBy(*order)
    within = F.coalesce(F.sum(weight).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight \
        else F.row_number().over(rows) - 1
    left, right = cut.withColumn(name, within.cast("long")).alias("l"), pieces.alias("r")
    same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col(f"l.{part}") == F.col(f"r.{part}"))
    joined = left.join(right, same)
    keep = [F.col(f"l.{c}") for c in df.columns] + [(F.col(f"l.{name}") + F.col(f"r.{before}")).alias(name)]
    return joined.select(*keep, *([F.col(f"r.{whole}").alias(total)] if total else []))
