"""Topic catalogue used with the driver tables (A-6 shape: groups, topics, gates).

A catalogue is configuration, not data: it is a handful of rows that travels
to every executor as a broadcast side. Keywords were picked from phrases that
occur in the driver's invented corpus, including punctuated and dashed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: topic groups (id, label, display order) ---
GROUPS = (
    ("g1", "Connectives", 1),
    ("g2", "Romance and Germanic", 2),
    ("g3", "Symbols", 3),
    ("g4", "Phrases", 4),
)

# --- fixed values: topics (id, label, group, gated, keywords) ---
TOPICS = (
    ("t01", "Clarity", "g1", False, ("that the", "of the")),
    ("t02", "Links", "g1", False, ("with", "for the")),
    ("t03", "French", "g2", False, ("des", "que")),
    ("t04", "German", "g2", False, ("und", "mit")),
    ("t05", "Marks", "g3", False, ("that***", "for&&&")),
    ("t06", "Money", "g3", False, ("this$$$", "the$$$")),
    ("t07", "Dashed", "g4", False, ("on-the",)),
    ("t08", "Gated by language", "g4", True, ("the",)),
    ("t09", "Gated by connective", "g3", True, ("est", "la")),
    ("t10", "Gated by itself", "g4", True, ("this",)),
    ("t11", "Phone", "g1", False, ("555",)),
    ("t12", "Single star", "g3", False, ("this*",)),
)

# --- fixed values: context gates (topic, any one of these groups must have an ungated hit) ---
GATES = (
    ("t08", "g2"),
    ("t09", "g1"),
    ("t09", "g4"),
    ("t10", "g4"),
)


def rules_df(spark: SparkSession) -> DataFrame:
    rows = [(tid, label, gid, gated, kw) for tid, label, gid, gated, kws in TOPICS for kw in kws]
    return spark.createDataFrame(rows, "topic_id string, label string, group_id string, gated boolean, keyword string")


def topics_df(spark: SparkSession) -> DataFrame:
    rows = [(tid, label, gid, gated) for tid, label, gid, gated, _ in TOPICS]
    return spark.createDataFrame(rows, "topic_id string, label string, group_id string, gated boolean")


def groups_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUPS), "id string, label string, ord int")


def gates_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GATES), "topic_id string, required_group string")


def tags_df(spark: SparkSession) -> DataFrame:
    """The tag dimension: one tag per topic."""
    return topics_df(spark).selectExpr("topic_id AS id", "label")


def _sql_lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, columns) -> str:
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def rules_sql() -> str:
    rows = [(tid, label, gid, gated, kw) for tid, label, gid, gated, kws in TOPICS for kw in kws]
    return values_sql(rows, ["topic_id", "label", "group_id", "gated", "keyword"])


def topics_sql() -> str:
    return values_sql([(t, l, g, gt) for t, l, g, gt, _ in TOPICS], ["topic_id", "label", "group_id", "gated"])


def groups_sql() -> str:
    return values_sql(GROUPS, ["id", "label", "ord"])


def gates_sql() -> str:
    return values_sql(GATES, ["topic_id", "required_group"])
