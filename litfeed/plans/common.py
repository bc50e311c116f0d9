"""Shared building blocks for registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litfeed.functions.text import CASEFOLD_EXTRA, TOKEN_CLASS
from litfeed.operators import classify as C
from litfeed.session import checkpoint_dir, ensure_utc, ship_package
from litfeed.sources import catalog, standins

TS_FMT = "yyyy-MM-dd HH:mm:ss"
SQL_TS_FMT = "%Y-%m-%d %H:%M:%S"


def ts_text(col) -> F.Column:
    return F.date_format(col, TS_FMT)


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '{SQL_TS_FMT}')"


class Ctx:
    """Per-query access to the stand-in tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ensure_utc(spark)
        ship_package(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self._memo: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return standins.read(self.spark, self.sf_dir, name)

    def articles(self) -> DataFrame:
        return standins.articles(self.spark, self.sf_dir)

    def journals(self) -> DataFrame:
        return standins.journals(self.spark, self.sf_dir)

    def rules(self) -> DataFrame:
        return catalog.rules_df(self.spark)

    def topics(self) -> DataFrame:
        return catalog.topics_df(self.spark)

    def gates(self) -> DataFrame:
        return catalog.gates_df(self.spark)

    def groups(self) -> DataFrame:
        return catalog.groups_df(self.spark)

    def tags(self) -> DataFrame:
        return catalog.tags_df(self.spark)

    def article_tags(self, method: str = "auto") -> DataFrame:
        """The link table, computed once per query and written to the shared
        checkpoint folder (``spark.checkpoint.dir``) so every consumer reads it
        back instead of re-running the classifier."""
        key = f"tags:{method}"
        if key not in self._memo:
            checkpoint_dir(self.spark)
            tags = C.classify(self.articles(), self.rules(), self.topics(), self.gates(), method=method)
            self._memo[key] = tags.checkpoint(eager=True)
        return self._memo[key]

    def fetches(self) -> DataFrame:
        return standins.fetches(self.spark, self.sf_dir)

    def items(self, conflict: bool = False) -> DataFrame:
        return standins.items(self.spark, self.sf_dir, conflict)


# ---- SQL side: classification twin (consuming-boundary form for RE2) ----
_WS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"


def sql_casefold(expr: str) -> str:
    out = f"lower({expr})"
    for a, b in CASEFOLD_EXTRA:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def sql_norm(expr: str) -> str:
    """clean (whitespace collapse) + match normalisation, DuckDB form."""
    folded = sql_casefold(f"trim(regexp_replace({expr}, '[{_WS}]+', ' ', 'g'))")
    return f"trim(regexp_replace({folded}, '[{_WS}\\p{{Pd}}]+', ' ', 'g'))"


SQL_CLASSIFY = {
    "q_rules": f"""
SELECT topic_id, kw,
  '(^|[^{TOKEN_CLASS}' || regexp_replace(punct, '([^{TOKEN_CLASS} ])', '\\\\\\1', 'g') || '])'
  || regexp_replace(kw, '([^{TOKEN_CLASS} ])', '\\\\\\1', 'g')
  || '($|[^{TOKEN_CLASS}' || regexp_replace(punct, '([^{TOKEN_CLASS} ])', '\\\\\\1', 'g') || '])' AS pat
FROM (SELECT topic_id, kw, regexp_replace(kw, '[\\s{TOKEN_CLASS}\\p{{Pd}}]', '', 'g') AS punct
      FROM (SELECT topic_id, {sql_norm('keyword')} AS kw FROM v_rules))""",
    "q_fields": f"""
SELECT uid, 'title' AS field, {sql_norm('title')} AS txt FROM v_articles WHERE title IS NOT NULL
UNION ALL SELECT uid, 'abstract' AS field, {sql_norm('abstract')} AS txt FROM v_articles WHERE abstract IS NOT NULL""",
    "q_hits": """
SELECT DISTINCT f.uid, r.topic_id FROM q_fields f JOIN q_rules r ON contains(f.txt, r.kw) AND regexp_matches(f.txt, r.pat)""",
    "q_ghits": """
SELECT h.uid, h.topic_id, t.group_id, t.gated FROM q_hits h JOIN v_topics t USING (topic_id)""",
    "q_article_tags": """
SELECT uid AS article_uid, topic_id AS tag_id FROM q_ghits WHERE NOT gated
UNION
SELECT g.uid, g.topic_id FROM q_ghits g JOIN v_gates gt ON gt.topic_id = g.topic_id
WHERE g.gated AND EXISTS (SELECT 1 FROM q_ghits o WHERE o.uid = g.uid AND NOT o.gated AND o.group_id = gt.required_group)""",
}
CLASSIFY_VIEWS = ("v_articles", "v_rules", "v_topics", "v_gates")
