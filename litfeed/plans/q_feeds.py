"""Feed-body parsing, HTML cleaning and DOI extraction queries (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from litfeed.functions.doi import normalize_doi
from litfeed.functions.text import clean_text
from litfeed.plans.common import Ctx, ts_text
from litfeed.plans.registry import query
from litfeed.sources import feeds as FD
from litfeed.sources import standins


@query("feed_parse", "A-2, A-3, A-4, B-14, C-8, C-9")
def feed_parse(spark, sf_dir):
    Ctx(spark, sf_dir)
    items = FD.parse_feeds(standins.raw_feeds(spark, sf_dir))
    return items.select("feed_id", "seq", "item_index", "title", "link", "published", "raw_type",
                        F.size("authors").alias("n_authors"), "error_class")


@query("feed_canonical", "B-10..B-15, D-10")
def feed_canonical(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    items = FD.parse_feeds(standins.raw_feeds(spark, sf_dir))
    ev = FD.canonicalize(items, c.journals())
    return ev.select("seq", "item_index", "uid", "doi", "journal_id", "title", "normalized_url",
                     ts_text("published_at").alias("published_at"), "article_type",
                     F.array_join("authors", "|").alias("authors"), "error_class")


@query("html_clean_pages", "B-1")
def html_clean_pages(spark, sf_dir):
    from litfeed.operators.util import ensure_parallel
    p = ensure_parallel(Ctx(spark, sf_dir).table("pages").select("page_id", "html"), "page_id")
    return p.select("page_id", clean_text(F.col("html")).alias("text"))


@query("doi_extract", "B-9, B-10", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '10.1234/abc(1)x' WHEN 1 THEN '10.5555/q%2fz' WHEN 4 THEN '10.5555/d' || doc_id END AS doi
FROM documents""")
def doi_extract(spark, sf_dir):
    """DOIs from prose: each document's text with a DOI-shaped phrase spliced in by rule."""
    d = Ctx(spark, sf_dir).table("documents").select("doc_id", "text")
    k = F.col("doc_id") % 6
    phrase = (F.when(k == 0, F.lit(" (see doi:10.1234/ABC(1)x).) "))
              .when(k == 1, F.lit(" https://doi.org/10.5555/Q%2Fz. "))
              .when(k == 2, F.lit(" 10.1000/unbalanced( "))
              .when(k == 3, F.lit(" DOI: 10.12/short "))
              .when(k == 4, F.concat(F.lit(" 10.5555/d"), F.col("doc_id").cast("string"), F.lit("]. ")))
              .otherwise(F.lit(" ")))
    at = F.instr("text", "\n")  # after the first line; at the end of a text of one line
    t = F.when(at > 0, F.concat(F.substr("text", F.lit(1), at - 1), phrase, F.substr("text", at))).otherwise(F.concat("text", phrase))
    return d.select("doc_id", normalize_doi(t, "free_text").alias("doi"))
