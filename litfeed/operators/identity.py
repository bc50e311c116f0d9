"""Entity resolution without graph iteration (D-1, F-3, H-1, H-9).

In feed data every record has a usable URL and a DOI-bearing record links its
URL to that DOI, so identities form stars (one DOI, many URLs):

* ``url_doi[u]``  = the DOI of the first item carrying URL ``u`` with a DOI;
* ``entity``      = coalesce(doi, url_doi[url], 'url:' || url);
* survivor UID    = for a DOI entity, its first DOI-bearing item ``f``: if an
  earlier item carried ``f.url``, the row created then (``url:<hash>``)
  survives; otherwise ``doi:<doi>``. URL-only entities keep ``url:<hash>``.

Plan: one aggregate by URL, one join back (AQE splits skewed URLs), one
aggregate by entity, one join back. Aggregates combine map-side, so a URL or
DOI holding a third of all rows never lands whole in one task.

Stored rows have a third key, their UID, which names a row whose alias was lost
(``lookup``) and may unite rows that share neither DOI nor URL (``united``: the
only place where labels have to spread in rounds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.functions.articles import short_sha256


def url_links(items: DataFrame) -> DataFrame:
    """Per URL: its DOI (first DOI-bearing item), that item's seq, first sighting."""
    has = F.col("doi").isNotNull()
    return items.groupBy("url").agg(
        F.min_by(F.when(has, F.col("doi")), F.when(has, F.col("seq"))).alias("url_doi"),
        F.min(F.when(has, F.col("seq"))).alias("link_seq"),
        F.min("seq").alias("url_first_seq"),
    )


def with_entity(items: DataFrame) -> DataFrame:
    """Items + ``url_doi``, ``link_seq``, ``url_first_seq`` and ``entity``."""
    j = items.join(url_links(items), "url", "left")
    return j.withColumn("entity", F.coalesce(F.col("doi"), F.col("url_doi"), F.concat(F.lit("url:"), F.col("url"))))


def entities(keyed: DataFrame) -> DataFrame:
    """Per entity: DOI, first DOI item's URL/seq, survivor UID, counts."""
    has = F.col("doi").isNotNull()
    e = keyed.groupBy("entity").agg(
        F.max("doi").alias("doi"),
        F.min_by(F.when(has, F.struct("url", "url_first_seq")), F.when(has, F.col("seq"))).alias("f"),
        F.min(F.when(has, F.col("seq"))).alias("f_seq"),
        F.min_by("url", "seq").alias("first_url"),
        F.count(F.lit(1)).alias("n_items"),
        F.count_distinct("url").alias("n_urls"),
        F.min("seq").alias("first_seq"),
    )
    url_uid = lambda u: F.concat(F.lit("url:"), short_sha256(u))
    uid = (F.when(F.col("doi").isNull(), url_uid(F.col("first_url")))
           .when(F.col("f.url_first_seq") < F.col("f_seq"), url_uid(F.col("f.url")))
           .otherwise(F.concat(F.lit("doi:"), F.col("doi"))))
    return e.select("entity", "doi", F.col("f.url").alias("f_url"), "f_seq", uid.alias("uid"),
                    "n_items", "n_urls", "first_seq")


def resolve(items: DataFrame) -> DataFrame:
    """Items with entity key, survivor uid and the merge ``phase``.

    ``phase`` = -link_seq for items of a URL that formed its own row before the
    URL was linked to the entity's DOI (an absorbed row), else 0.
    """
    keyed = with_entity(items)
    ent = entities(keyed).select("entity", "uid", "f_url")
    r = keyed.join(ent, "entity")
    absorbed = (F.col("link_seq").isNotNull() & (F.col("url") != F.col("f_url")) & (F.col("seq") < F.col("link_seq")))
    return r.withColumn("phase", F.when(absorbed, -F.col("link_seq")).otherwise(F.lit(0)))


def alias_table(items: DataFrame) -> DataFrame:
    """H-1 / F-3: every URL ever seen points at its entity's survivor."""
    keyed = with_entity(items)
    ent = entities(keyed).select("entity", "uid")
    return keyed.select("url", "entity").distinct().join(ent, "entity").select(
        F.col("url").alias("normalized_url"), F.col("uid").alias("article_uid"))


def conflict_keys(items: DataFrame) -> DataFrame:
    """H-9 taint: URL with several DOIs, DOI with several journals, URL with several journals."""
    def taint(kind, key, val, df):
        return (df.where(F.col(key).isNotNull() & F.col(val).isNotNull()).groupBy(F.col(key).alias("key"))
                .agg(F.count_distinct(val).alias("n")).where("n > 1").select(F.lit(kind).alias("key_type"), "key", "n"))
    return (taint("url_dois", "url", "doi", items)
            .unionByName(taint("doi_journals", "doi", "journal_id", items))
            .unionByName(taint("url_journals", "url", "journal_id", items)))


def lookup(items: DataFrame, articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """D-1 against stored rows: which rows an item's DOI, URL and UID name.

    ``items(seq, doi, url, named_uid, journal_id)``; three equi-joins, no order among the items. A URL names the row of its alias; without
    an alias the row whose own URL it is (``repairs``: that alias is missing; of several such rows the one with the
    smallest UID). ``uid`` is the row that survives (DOI before URL before UID; null: the item makes a new row), ``merges`` the other rows
    that the item names, in that order. ``conflict``: a named row belongs to another journal, or the DOIs of the named rows and of
    the item are not one. Null keys name nothing; repeated items each get their row of the result.
    """
    row = F.struct("uid", "doi", "journal_id")
    stored = articles.select("uid", "doi", "journal_id", "normalized_url")
    by_doi = stored.where(F.col("doi").isNotNull()).select(F.col("doi").alias("k_doi"), row.alias("r_doi"))
    by_uid = stored.select(F.col("uid").alias("k_uid"), row.alias("r_uid"))
    own = stored.where(F.col("normalized_url").isNotNull()).groupBy(F.col("normalized_url").alias("k_url")).agg(F.min(row).alias("r_own"))
    named = aliases.select(F.col("normalized_url").alias("k_url"), F.col("article_uid").alias("k_uid")).join(by_uid, "k_uid").select(
        "k_url", F.col("r_uid").alias("r_alias"))
    by_url = named.join(own, "k_url", "full_outer")
    found = (items.select("seq", "doi", "url", "named_uid", "journal_id")
             .join(by_doi, F.col("doi") == F.col("k_doi"), "left").join(by_url, F.col("url") == F.col("k_url"), "left")
             .join(by_uid, F.col("named_uid") == F.col("k_uid"), "left"))
    rows = F.array_compact(F.array("r_doi", F.coalesce("r_alias", "r_own"), "r_uid"))
    found = found.select("seq", "doi", "journal_id", rows.alias("rows"),
                         (F.col("r_alias").isNull() & F.col("r_own").isNotNull()).alias("repairs"), F.col("r_uid.uid").alias("uid_uid"))
    uids = F.array_distinct(F.transform("rows", lambda r: r["uid"]))
    dois = F.array_distinct(F.array_compact(F.concat(F.transform("rows", lambda r: r["doi"]), F.array("doi"))))
    return found.select(
        "seq", F.get(uids, F.lit(0)).alias("uid"), F.slice(uids, 2, 2).alias("merges"), "repairs", "uid_uid",
        ((F.size(dois) > 1) | F.exists("rows", lambda r: ~r["journal_id"].eqNullSafe(F.col("journal_id")))).alias("conflict"))


def united(merges: DataFrame) -> DataFrame:
    """(uid, root, since) for the rows that ``merges(loser, survivor, seq)`` unite: ``root`` survives, ``since`` is the first item
    that named a row together with another.

    Rows united by several items end in one root: the survivor of the last item among the rows that no item makes a loser (if every
    row loses once, the survivor of the first item). Labels spread by minimum with pointer jumping, so the number of rounds
    grows with the logarithm of a chain; pairs are one round.
    """
    edges = merges.where(F.col("loser") != F.col("survivor")).select("loser", "survivor", "seq").checkpoint(eager=True)
    both = edges.select(F.col("loser").alias("a"), F.col("survivor").alias("b")).unionByName(
        edges.select(F.col("survivor").alias("a"), F.col("loser").alias("b"))).distinct().checkpoint(eager=True)
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("uid"), F.least("a", "m").alias("label")).checkpoint(eager=True)
    while True:
        near = both.join(label.select(F.col("uid").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("uid")).agg(
            F.min("near").alias("near"))
        jump = label.select(F.col("uid").alias("label"), F.col("label").alias("jump"))
        hop = label.join(near, "uid").join(jump, "label").select("uid", "label", F.least("near", "jump").alias("least"))
        # the better label also goes to the row that labelled this one before, so whole trees hook on to each other
        hooked = hop.select("uid", F.least("label", "least").alias("label")).unionByName(
            hop.select(F.col("label").alias("uid"), F.least("label", "least").alias("label")))
        after = hooked.groupBy("uid").agg(F.min("label").alias("label")).checkpoint(eager=True)
        moved = not after.join(label.withColumnRenamed("label", "before"), "uid").where("label <> before").isEmpty()
        label = after
        if not moved:
            break
    e = edges.join(label.select(F.col("uid").alias("survivor"), "label"), "survivor")
    lost = edges.select(F.col("loser").alias("survivor")).distinct()
    root = e.join(lost.withColumn("lost", F.lit(True)), "survivor", "left").groupBy("label").agg(F.coalesce(
        F.max_by("survivor", F.when(F.col("lost").isNull(), F.struct("seq", "survivor"))), F.min_by("survivor", F.struct("seq", "survivor"))).alias("root"))
    first = edges.select(F.col("loser").alias("uid"), "seq").unionByName(edges.select(F.col("survivor").alias("uid"), "seq")).groupBy("uid").agg(
        F.min("seq").alias("since"))
    return label.join(root, "label").join(first, "uid").select("uid", "root", "since")
