"""Enrichment from landed metadata payloads (A-11, A-12, D-9, I-1 .. I-7).

Bibliographic (Crossref-shaped) and open-access (Unpaywall-shaped) responses
are landed tables ``(doi, http_status, payload)``; enrichment is two left
equi-joins on the DOI. A missing row, a non-2xx status, an oversized body or
a malformed payload is a failed source for that record only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litfeed.constants import MAX_METADATA_BYTES
from litfeed.functions import articles as AF
from litfeed.functions.binding import let
from litfeed.functions.text import casefold, visible_text


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def latest(landed: DataFrame) -> DataFrame:
    """One response per DOI: the last one fetched (``fetched_at``, where landed), a successful one first. Records without a
    DOI are never asked about, so neither are responses without one kept."""
    when = [F.col("fetched_at")] if "fetched_at" in landed.columns else []
    rank = F.struct(F.col("http_status").between(200, 299).alias("ok"), *when, "http_status", "payload")
    return landed.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.max_by(F.struct("http_status", "payload"), rank).alias("r")).select(
        "doi", "r.http_status", "r.payload")


def parse_crossref(crossref: DataFrame) -> DataFrame:
    """(doi, cr_ok, cr_titles, cr_authors, cr_abstract, cr_type) — one row per DOI."""
    crossref = latest(crossref).withColumn("_v", F.try_parse_json("payload"))  # parsed once, read by every extractor
    v = F.col("_v")
    ok = (F.col("http_status").between(200, 299) & (F.octet_length("payload") <= MAX_METADATA_BYTES)
          & _kind(v, "$.message").startswith("OBJECT"))
    tkind = _kind(v, "$.message.title")
    titles = (F.when(tkind.startswith("ARRAY"), F.try_variant_get(v, "$.message.title", "array<string>"))
              .when(tkind == "STRING", F.array(F.try_variant_get(v, "$.message.title", "string"))))
    akind = _kind(v, "$.message.abstract")
    tykind = _kind(v, "$.message.type")
    authors = F.try_variant_get(v, "$.message.author", "array<struct<given:string,family:string,name:string>>")
    return crossref.select(
        "doi", F.coalesce(ok, F.lit(False)).alias("cr_ok"), titles.alias("cr_titles"), authors.alias("cr_authors"),
        F.when(akind == "STRING", F.try_variant_get(v, "$.message.abstract", "string")).alias("cr_abstract"),
        F.when(tykind == "STRING", F.try_variant_get(v, "$.message.type", "string")).alias("cr_type"))


def parse_unpaywall(unpaywall: DataFrame) -> DataFrame:
    """(doi, up_ok, up_is_oa): ``is_oa`` must be a real JSON boolean."""
    unpaywall = latest(unpaywall).withColumn("_v", F.try_parse_json("payload"))
    v = F.col("_v")
    ok = (F.col("http_status").between(200, 299) & (F.octet_length("payload") <= MAX_METADATA_BYTES)
          & (_kind(v, "$.is_oa") == "BOOLEAN"))
    return unpaywall.select("doi", F.coalesce(ok, F.lit(False)).alias("up_ok"),
                            F.try_variant_get(v, "$.is_oa", "boolean").alias("up_is_oa"))


def _crossref_author_names(authors: Column) -> Column:
    def name(a: Column) -> Column:
        parts = F.struct(visible_text(a["given"]).alias("given"), visible_text(a["family"]).alias("family"))
        return let(parts, lambda p: F.when(p["given"].isNotNull() | p["family"].isNotNull(), F.concat_ws(" ", p["given"], p["family"]))
                   .otherwise(visible_text(a["name"])))

    names = F.transform(authors, name)
    return AF.first_spellings(F.filter(names, lambda n: n.isNotNull() & AF.authors_known(F.array(n))))


def enrich(records: DataFrame, crossref: DataFrame, unpaywall: DataFrame | None) -> DataFrame:
    """Apply both sources. ``unpaywall=None`` means the open-access source is not asked."""
    # cleaned on the side of the payloads, once per DOI
    cr = parse_crossref(crossref)
    titles = F.filter(F.transform("cr_titles", visible_text), lambda t: t.isNotNull() & AF.title_known(t))
    cr = cr.select("doi", "cr_ok", F.try_element_at(titles, F.lit(1)).alias("cr_title"), _crossref_author_names(F.col("cr_authors")).alias("cr_names"),
                   visible_text(F.col("cr_abstract")).alias("cr_abstract"), visible_text(F.col("cr_type")).alias("cr_type"))
    r = records.join(cr, "doi", "left")
    if unpaywall is not None:
        r = r.join(parse_unpaywall(unpaywall), "doi", "left")
    has_doi = F.col("doi").isNotNull() & (F.trim("doi") != "")
    cr_ok = has_doi & F.coalesce(F.col("cr_ok"), F.lit(False))

    new_title = F.when(cr_ok & ~let(visible_text(F.col("title")), AF.title_known), F.col("cr_title"))
    cr_auth = F.col("cr_names")
    low_auth = ~let(F.transform("authors", visible_text), AF.authors_known)
    new_auth = F.when(cr_ok & low_auth & (F.size(cr_auth) > 0), cr_auth)
    cr_abs = F.col("cr_abstract")
    new_abs = F.when(cr_ok & ~let(visible_text(F.col("abstract")), AF.abstract_known) & AF.abstract_known(cr_abs), cr_abs)
    cr_type = AF.article_type(F.col("cr_type"))
    new_type = F.when(cr_ok & (casefold(F.col("article_type")) == "other") & F.col("cr_type").isNotNull()
                      & (cr_type != "other"), cr_type)
    contributed = [("title", new_title), ("authors", new_auth), ("abstract", new_abs), ("article_type", new_type)]
    out = r.withColumns({f"_new_{f}": newv for f, newv in contributed})
    flags = [F.when(F.col(f"_new_{f}").isNotNull(), F.lit(f)) for f, _ in contributed]
    statuses = [cr_ok]
    if unpaywall is not None:
        up_ok = has_doi & F.coalesce(F.col("up_ok"), F.lit(False))
        out = out.withColumn("_new_oa_status", F.when(up_ok, F.when(F.col("up_is_oa"), "open").otherwise("closed")))
        flags.append(F.when(F.col("_new_oa_status").isNotNull(), F.lit("oa_status")))
        statuses.append(up_ok)
        contributed.append(("oa_status", None))
    all_ok = statuses[0]
    for s in statuses[1:]:
        all_ok = all_ok & s
    requested = F.when(all_ok, F.lit("enriched")).otherwise(F.lit("partial"))
    new_fields = F.filter(F.array(*flags), lambda x: x.isNotNull())
    fields = {f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f, _ in contributed}
    out = out.withColumns(fields | {"metadata_status": F.when(has_doi, AF.higher_status(F.col("metadata_status"), requested))
                         .otherwise(F.col("metadata_status")), "enriched_fields": F.when(has_doi, AF.provenance_order(
        F.array_union(F.coalesce("enriched_fields", F.array().cast("array<string>")), new_fields)))
        .otherwise(F.col("enriched_fields"))})
    drop = [c for c in out.columns if c.startswith("_new_") or c.startswith("cr_") or c.startswith("up_")]
    return out.drop(*drop)
