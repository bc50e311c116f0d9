"""Article-level column functions (B-7, B-8, B-13, B-17 .. B-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litfeed.constants import (
    ABSTRACT_PLACEHOLDERS,
    ARTICLE_TYPE_PATTERNS,
    AUTHOR_PLACEHOLDERS,
    ENRICHABLE_FIELD_ORDER,
    METADATA_STATUS_RANK,
    NEWS_ARTICLE_PATTERN,
    TITLE_PLACEHOLDERS,
    UID_FIELD_SEPARATOR,
)
from litfeed.functions.binding import let
from litfeed.functions.text import WS_CLASS, casefold, placeholder_key


def article_type(cleaned: Column) -> Column:
    """B-7: ordered case-insensitive patterns; 'news article' cancels research."""
    expr = None
    for name, pattern in ARTICLE_TYPE_PATTERNS:
        hit = cleaned.rlike("(?i)" + pattern)
        value = F.lit(name)
        if name == "research":
            value = F.when(cleaned.rlike("(?i)" + NEWS_ARTICLE_PATTERN), F.lit("other")).otherwise(F.lit(name))
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return F.coalesce(expr.otherwise(F.lit("other")), F.lit("other"))


def short_sha256(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 24)


def candidate_uid(doi: Column, normalized_url: Column, journal_id: Column, title: Column,
                  published_date: Column) -> Column:
    """B-8: doi:<doi>, else url:<sha256[:24]>, else hash:<sha256[:24]> of
    journal, case-folded title and the UTC date (inputs already canonical)."""
    ident = F.concat_ws(UID_FIELD_SEPARATOR, F.coalesce(journal_id, F.lit("")),
                        casefold(F.coalesce(title, F.lit(""))), F.coalesce(published_date, F.lit("")))
    return F.coalesce(
        F.concat(F.lit("doi:"), doi),
        F.concat(F.lit("url:"), short_sha256(normalized_url)),
        F.concat(F.lit("hash:"), short_sha256(ident)),
    )


def distinct_authors(authors: Column) -> Column:
    """B-13: drop blanks, keep the first spelling of each case-insensitive name, in order."""
    cleaned = F.filter(F.transform(authors, lambda a: F.trim(F.regexp_replace(a, r"[\s\p{Z}]+", " "))),
                       lambda a: a.isNotNull() & (a != ""))
    return first_spellings(cleaned)


def first_spellings(names: Column) -> Column:
    """The first of each case-insensitive name, in order."""
    def kept(given: Column) -> Column:
        # sorted by name and place, the first of each run of equal names; then in order of place again
        by_name = F.sort_array(F.transform(given, lambda a, i: F.struct(casefold(a).alias("k"), i.alias("i"))))
        first = let(by_name, lambda s: F.filter(s, lambda x, j: ~F.get(s, j - 1)["k"].eqNullSafe(x["k"])))
        return F.transform(F.sort_array(F.transform(first, lambda x: x["i"])), lambda i: F.get(given, i))
    return let(names, kept)


def _meaningful_text(col: Column, placeholders) -> Column:
    # folding makes no text shorter: one that begins with more characters than the longest placeholder has (white space and punctuation
    # aside) is none, and need not be folded whole
    longer = rf"^(?:[{WS_CLASS}\p{{P}}]*+[^{WS_CLASS}\p{{P}}]){{{max(map(len, placeholders)) + 1}}}"
    key = placeholder_key(col)  # casefold + punctuation strip
    return F.when(col.rlike(longer), F.lit(True)).otherwise(F.coalesce(col.isNotNull() & (key != "") & ~key.isin(*placeholders), F.lit(False)))


def title_known(col: Column) -> Column:
    return _meaningful_text(col, TITLE_PLACEHOLDERS)


def abstract_known(col: Column) -> Column:
    return _meaningful_text(col, ABSTRACT_PLACEHOLDERS)


def authors_known(col: Column) -> Column:
    return F.coalesce(F.exists(col, lambda a: _meaningful_text(a, AUTHOR_PLACEHOLDERS)), F.lit(False))


def published_known(col: Column) -> Column:
    return col.isNotNull()


def type_known(col: Column) -> Column:
    return F.coalesce((F.trim(col) != "") & (F.lower(col) != "other"), F.lit(False))


def oa_known(col: Column) -> Column:
    return F.coalesce(col.isin("open", "closed"), F.lit(False))


KNOWN = {
    "title": title_known,
    "authors": authors_known,
    "abstract": abstract_known,
    "published_at": published_known,
    "article_type": type_known,
    "oa_status": oa_known,
}


def provenance_order(fields: Column) -> Column:
    """B-19: canonical order, duplicates and unknown names dropped."""
    canon = F.array(*[F.lit(f) for f in ENRICHABLE_FIELD_ORDER])
    return F.filter(canon, lambda f: F.array_contains(F.coalesce(fields, F.array().cast("array<string>")), f))


def provenance_unknown(fields: Column) -> Column:
    """Names outside the six enrichable fields (a corrupt row)."""
    canon = F.array(*[F.lit(f) for f in ENRICHABLE_FIELD_ORDER])
    return F.array_except(F.coalesce(fields, F.array().cast("array<string>")), canon)


def status_rank(col: Column) -> Column:
    m = F.create_map(*[x for k, v in METADATA_STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    return m[col]


def rank_status(rank: Column) -> Column:
    m = F.create_map(*[x for k, v in METADATA_STATUS_RANK.items() for x in (F.lit(v), F.lit(k))])
    return m[rank]


def higher_status(a: Column, b: Column) -> Column:
    """B-18."""
    return rank_status(F.greatest(status_rank(a), status_rank(b)))
