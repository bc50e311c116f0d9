"""Incremental update run as Structured Streaming (J-1 .. J-5).

``readStream`` over the landing folder of raw feed bodies, ``trigger
(availableNow)``, and one ``foreachBatch`` per micro-batch that:

1. parses and canonicalises the new bodies (quarantining bad ones), drops
   items already applied (key: feed, body seq, item index; J-4);
2. finds the stored articles the batch touches: same DOI, or a URL alias of a
   batch URL (one hop is enough: identities are stars), a row whose own URL or
   UID a batch item names (an alias that was lost is written again);
3. folds the batch into just those entities: each touched article enters as
   one state item carrying its values and provenance flags, its aliases as
   link-only items, all ordered before the batch, then ``identity.resolve`` +
   ``merge.merge`` (stored UIDs survive). Untouched articles, their aliases
   and their tag links are carried over unchanged; only touched entities are
   retagged (same result as retagging all, J-5);
4. writes the new snapshot, gates the written data, then moves the pointer.

Work per batch is proportional to the batch and the entities it touches, not
to the whole history. Any time-ordered split of the history gives the same
snapshot as one batch (``tests/test_stream.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litfeed.constants import ENRICHABLE_FIELD_ORDER
from litfeed.operators import classify as C
from litfeed.operators import conflicts as K
from litfeed.operators import feedstate as FS
from litfeed.operators import runs as R
from litfeed.operators import identity as I
from litfeed.operators import merge as M
from litfeed.operators import outcomes as O
from litfeed.operators import snapshot as SN
from litfeed.operators import tags as T
from litfeed.operators.util import bounded_broadcast
from litfeed.session import Scratch, checkpoint_dir, released_shuffles
from litfeed.sources import feeds as FD

ITEM_KEY = ("journal_id", "seq", "item_index")
FIELDS = ENRICHABLE_FIELD_ORDER
ARTICLE_COLUMNS = ("uid", "doi", "journal_id", "title", "abstract", "authors", "published_at", "article_type",
                   "article_url", "normalized_url", "oa_status", "source_feed_url", "metadata_status", "enriched_fields",
                   "first_seen_at", "last_updated_at")
#: Columns that each item sets anew.
LATEST = ("article_url", "source_feed_url")
#: Items are ordered by batch, body and place in the body, in one decimal: 20 bits for the place (a body of the allowed
#: size holds fewer items), 64 for the body.
WIDE = "decimal(38,0)"
BODY_SPAN, BATCH_SPAN = Decimal(1 << 20), Decimal(1 << 84)


def order_key(batch_id: int):
    return (F.lit(Decimal(batch_id) * BATCH_SPAN).cast(WIDE) + F.col("seq").cast(WIDE) * F.lit(BODY_SPAN).cast("decimal(18,0)")
            + F.col("item_index").cast(WIDE)).cast(WIDE)


def _batch_items(events: DataFrame, batch_id: int) -> DataFrame:
    ef = F.coalesce("enriched_fields", F.array().cast("array<string>"))
    return events.select(
        order_key(batch_id).alias("seq"), F.col("normalized_url").alias("url"), "doi", "journal_id", F.col("uid").alias("named_uid"), *FIELDS,
        *[F.array_contains(ef, f).alias(f"{f}_enr") for f in FIELDS],
        "metadata_status", "article_url", "source_feed_url",
        F.lit(False).alias("is_alias"), F.lit(None).cast("string").alias("stored_uid"),
        F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("last_updated_at"))


def unrepeated(events: DataFrame) -> DataFrame:
    """The usable ones of ``events`` (with ``_row``, a number of each row), each item once. Only keys are compared; texts stay where they are."""
    good = events.where(F.col("error_class").isNull())
    nth = F.row_number().over(Window.partitionBy(*ITEM_KEY).orderBy("_row"))
    again = good.select(*ITEM_KEY, "_row", nth.alias("nth")).where("nth > 1").select("_row").checkpoint(eager=True)
    return (good if again.isEmpty() else good.join(bounded_broadcast(again), "_row", "left_anti")).drop("_row")


def _state_items(articles: DataFrame, aliases: DataFrame, base: Decimal) -> DataFrame:
    ef = F.coalesce("enriched_fields", F.array().cast("array<string>"))
    st = articles.select(
        F.lit(base - 2).cast(WIDE).alias("seq"), F.col("normalized_url").alias("url"), "doi", "journal_id", *FIELDS,
        *[F.array_contains(ef, f).alias(f"{f}_enr") for f in FIELDS],
        "metadata_status", "article_url", "source_feed_url",
        F.lit(False).alias("is_alias"), F.col("uid").alias("stored_uid"), "first_seen_at", "last_updated_at")
    al = aliases.join(articles.select(F.col("uid").alias("article_uid"), "doi"), "article_uid").select(
        F.lit(base - 1).cast(WIDE).alias("seq"), F.col("normalized_url").alias("url"), "doi",
        F.lit(None).cast("string").alias("journal_id"), *[F.lit(None).cast(articles.schema[f].dataType).alias(f) for f in FIELDS],
        *[F.lit(False).alias(f"{f}_enr") for f in FIELDS], F.lit(None).cast("string").alias("metadata_status"),
        F.lit(None).cast("string").alias("article_url"), F.lit(None).cast("string").alias("source_feed_url"),
        F.lit(True).alias("is_alias"), F.lit(None).cast("string").alias("stored_uid"),
        F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("last_updated_at"))
    return st.unionByName(al)


@dataclass(frozen=True)
class Named:
    """What UIDs say about a batch beyond DOIs and URLs. ``rows``: (uid, root, since) of stored rows that are one; ``urls``: (url, root),
    the URLs that stand for a stored row; ``anchors``: (root, anchor), one URL for all of a row's; ``merging``: (seq) of items that unite rows."""
    rows: DataFrame
    urls: DataFrame
    anchors: DataFrame
    merging: DataFrame


def named_rows(look: DataFrame, items: DataFrame, arts: DataFrame, aliases: DataFrame) -> Named | None:
    """The rows that the items of ``look`` (``identity.lookup``) name by UID, and those without a DOI that have several URLs; None: there are
    none, DOIs and URLs tell all."""
    by_uid = look.where(F.col("uid_uid").isNotNull() & ~F.col("conflict"))
    merging = by_uid.where(F.array_contains("merges", F.col("uid_uid")))
    lost = by_uid.where(F.col("uid") == F.col("uid_uid")).join(items.select("seq", "url"), "seq").select("url", "uid").join(
        aliases.select(F.col("normalized_url").alias("url")), "url", "left_anti").join(
        arts.select(F.col("normalized_url").alias("url")), "url", "left_anti").distinct()
    owned = aliases.select(F.col("normalized_url").alias("url"), F.col("article_uid").alias("uid")).unionByName(
        arts.select(F.col("normalized_url").alias("url"), "uid").join(
            aliases.select(F.col("normalized_url").alias("url")), "url", "left_anti")).unionByName(lost).distinct().checkpoint(eager=True)
    plain = arts.where(F.col("doi").isNull()).select("uid")
    if merging.isEmpty() and owned.join(plain, "uid").groupBy("uid").count().where("count > 1").isEmpty() and lost.isEmpty():
        return None
    rows = I.united(merging.select(F.col("uid_uid").alias("loser"), F.col("uid").alias("survivor"), "seq")).checkpoint(eager=True)
    # rows named by one root, rows without a DOI, and rows that a UID alone names keep their URLs together
    every = arts.select("uid").join(rows, "uid", "left").select("uid", F.coalesce("root", "uid").alias("root"))
    urls = owned.join(every, "uid").select("url", "root")
    anchors = arts.select(F.col("uid").alias("root"), F.col("normalized_url").alias("anchor"))
    return Named(rows, urls.checkpoint(eager=True), anchors, merging.select("seq"))


def anchored(items: DataFrame, named: Named | None) -> DataFrame:
    """Items whose ``url`` is the one URL of their row (``own_url``: as given)."""
    items = items.withColumn("own_url", F.col("url"))
    if named is None:
        return items
    one = named.urls.join(named.anchors, "root").groupBy("url").agg(F.min("anchor").alias("anchor"))
    return items.join(one, "url", "left").withColumn("url", F.coalesce("anchor", "url")).drop("anchor")


def resolved_items(items: DataFrame, named: Named | None = None) -> DataFrame:
    """State + batch items of the touched entities with entity, phase and the uid that survives."""
    resolved = I.resolve(anchored(items, named))
    if named is not None:  # a row that another one takes in ranks below it, from the item on that names both
        losers = named.rows.where(F.col("uid") != F.col("root")).select(F.col("uid").alias("stored_uid"), F.col("root").alias("su_root"), "since")
        resolved = resolved.join(losers, "stored_uid", "left").withColumn(
            "phase", F.when(F.col("since").isNotNull(), -F.col("since")).otherwise(F.col("phase"))).drop("since")
    else:
        resolved = resolved.withColumn("su_root", F.lit(None).cast("string"))
    keep = resolved.groupBy("entity").agg(
        F.max(F.when(F.col("stored_uid").isNotNull() & F.col("doi").isNotNull(), F.col("stored_uid"))).alias("su_doi"),
        F.max(F.when(F.col("stored_uid").isNotNull() & (F.col("url") == F.col("f_url")), F.col("stored_uid"))).alias("su_f"),
        F.max("stored_uid").alias("su_any"), F.max("doi").alias("e_doi"), F.max("su_root").alias("su_root"))
    return resolved.drop("su_root").join(keep, "entity").withColumn(
        "uid", F.coalesce("su_root", "su_doi", "su_f", F.when(F.col("e_doi").isNull(), F.col("su_any")), F.col("uid"))).drop(
        "su_root", "su_doi", "su_f", "su_any", "e_doi")


def fold_entities(resolved: DataFrame, found: DataFrame, at: datetime) -> DataFrame:
    """``resolved_items`` and the batch's outcomes -> articles. ``at``: the time of the batch's items."""
    now = F.lit(at).cast("timestamp")
    resolved = resolved.withColumn("url", F.col("own_url"))
    merged = M.merge(resolved, fields=FIELDS)
    real = ~F.col("is_alias")
    changed = found.groupBy("entity").agg(F.bool_or(F.col("outcome") != "skipped").alias("changed"))
    extra = resolved.groupBy("entity").agg(
        *[F.max_by(c, F.when(real, F.col("seq"))).alias(c) for c in LATEST],
        F.min(F.when(real, F.coalesce("first_seen_at", now))).alias("first_seen_at"),
        F.max(F.when(real & (F.col("phase") == 0), F.col("last_updated_at"))).alias("kept_at"))
    last = F.when(F.coalesce("changed", F.lit(False)) | F.col("kept_at").isNull(), now).otherwise(F.col("kept_at"))
    return merged.join(extra, "entity").join(changed, "entity", "left").withColumn("last_updated_at", last).select(*ARTICLE_COLUMNS)


@dataclass(frozen=True)
class Upserted:
    """What a batch makes of the stored records. ``folded`` and ``aliases``: the entities it touched, as they are now; ``touched``: (uid) the
    stored articles that these replace; ``survivors``: (uid, survivor_uid) of the touched ones; ``rejected``: (seq) of
    items that contradict a record; ``outcomes``: (seq, entity, lifetime, outcome) of all others."""
    folded: DataFrame
    aliases: DataFrame
    touched: DataFrame
    survivors: DataFrame
    rejected: DataFrame
    outcomes: DataFrame

    def articles(self, old: DataFrame | None) -> DataFrame:
        """The whole new article table."""
        if old is None:
            return self.folded
        return old.join(self.touched, "uid", "left_anti").select(*ARTICLE_COLUMNS).unionByName(self.folded)

    def url_aliases(self, old: DataFrame | None) -> DataFrame:
        if old is None:
            return self.aliases
        touched = self.touched.withColumnRenamed("uid", "article_uid")
        return old.join(touched, "article_uid", "left_anti").select("normalized_url", "article_uid").unionByName(self.aliases)

    def links(self, old: DataFrame | None) -> DataFrame:
        """H-3: the tag links of the touched articles, those of merged rows united under the survivor."""
        return T.rekey_links(old.join(self.touched.withColumnRenamed("uid", "article_uid"), "article_uid", "left_semi"), self.survivors)


def upsert(old_arts: DataFrame | None, old_alias: DataFrame | None, new_items: DataFrame, batch_id: int, at: datetime,
           scratch: Scratch | None = None) -> Upserted:
    """H-5 for one batch of items (``_batch_items`` shape) against stored articles/aliases.

    Items that contradict a stored record or an earlier item of the batch are rejected (H-9). Identities are resolved on keys; texts
    move to their entity once. ``scratch``: where texts lie meanwhile (default: checkpoints); what is returned is valid as long as it is.
    """
    keep = scratch.keep if scratch is not None else lambda df, name: df.checkpoint(eager=True)
    drop = scratch.drop if scratch is not None else lambda *names: None
    checkpoint_dir(new_items.sparkSession)
    base = Decimal(batch_id) * BATCH_SPAN
    if "named_uid" not in new_items.columns:  # no item names a row by its UID
        new_items = new_items.withColumn("named_uid", F.lit(None).cast("string"))
    if old_arts is None:
        rejected = K.contradictions(new_items).checkpoint(eager=True)
        items, named = new_items.drop("named_uid").join(bounded_broadcast(rejected), "seq", "left_anti"), None
        touched = new_items.select(F.col("stored_uid").alias("uid")).where("false")
    else:
        b_urls = bounded_broadcast(new_items.select(F.col("url").alias("normalized_url")).distinct())
        b_dois = bounded_broadcast(new_items.where(F.col("doi").isNotNull()).select("doi").distinct())
        b_uids = bounded_broadcast(new_items.where(F.col("named_uid").isNotNull()).select(F.col("named_uid").alias("uid")).distinct())
        touched = (old_alias.join(b_urls, "normalized_url", "left_semi").select(F.col("article_uid").alias("uid"))
                   .unionByName(old_arts.join(b_dois, "doi", "left_semi").select("uid"))
                   .unionByName(old_arts.join(b_urls, "normalized_url", "left_semi").select("uid"))
                   .unionByName(old_arts.join(b_uids, "uid", "left_semi").select("uid")).distinct()).checkpoint(eager=True)
        t_arts = old_arts.join(bounded_broadcast(touched), "uid", "left_semi")
        t_alias = old_alias.join(touched.withColumnRenamed("uid", "article_uid"), "article_uid", "left_semi")
        stored = t_alias.join(t_arts.select(F.col("uid").alias("article_uid"), "doi", "journal_id"), "article_uid").select(
            F.col("normalized_url").alias("url"), "doi", "journal_id")
        fixed = K.claims(stored.withColumn("seq", F.lit(0))).drop("seq")
        look = I.lookup(new_items, t_arts, t_alias).checkpoint(eager=True)
        against = look.where(F.col("conflict") & F.col("uid_uid").isNotNull()).select("seq")
        rejected = K.contradictions(new_items.join(against, "seq", "left_anti"), fixed).unionByName(against).checkpoint(eager=True)
        kept = new_items.join(bounded_broadcast(rejected), "seq", "left_anti")
        named = named_rows(look.join(rejected, "seq", "left_anti"), kept, t_arts, t_alias)
        items = _state_items(t_arts, t_alias, base).unionByName(kept.drop("named_uid"))
    items = keep(items.withColumn("_row", F.monotonically_increasing_id()), "items")
    narrow = ("seq", "url", "doi", "stored_uid")
    keys = resolved_items(items.select("_row", *narrow), named).checkpoint(eager=True)
    resolved = keep(items.drop(*narrow).join(keys, "_row").drop("_row"), "resolved")
    drop("items")
    latest = LATEST if named is None else (*LATEST, "own_url")
    found = O.outcomes(resolved, FIELDS, chunk=1 << 20, latest=latest).where(F.col("seq") >= F.lit(base).cast(WIDE))
    if named is not None:
        found = found.join(named.merging.withColumn("unites", F.lit(True)), "seq", "left").withColumn(
            "outcome", F.when(F.col("unites"), "updated").otherwise(F.col("outcome"))).drop("unites")
    found = found.checkpoint(eager=True)
    folded = keep(fold_entities(resolved, found, at), "folded")
    drop("resolved")
    aliases = keys.select(F.col("own_url").alias("normalized_url"), F.col("uid").alias("article_uid")).distinct()
    survivors = keys.where(F.col("stored_uid").isNotNull()).select(F.col("stored_uid").alias("uid"), F.col("uid").alias("survivor_uid"))
    return Upserted(folded, aliases, touched, survivors, rejected, found)


def apply_batch(spark: SparkSession, batch: DataFrame, batch_id: int, root: str, journals: DataFrame,
                rules: DataFrame, topics: DataFrame, gates: DataFrame, enricher=None, at: datetime | None = None) -> dict:
    """One micro-batch. ``enricher`` (K-2) is any ``DataFrame -> DataFrame`` applied
    to the canonical events, e.g. ``lambda ev: enrich(ev, crossref, unpaywall)``. ``at``: the time of the run (default: now)."""
    with Scratch(spark, "litfeed-batch") as scratch:
        return _apply_batch(spark, batch, batch_id, root, journals, rules, topics, gates, enricher, at, scratch)


def _apply_batch(spark: SparkSession, batch: DataFrame, batch_id: int, root: str, journals: DataFrame, rules: DataFrame,
                 topics: DataFrame, gates: DataFrame, enricher, at: datetime | None, scratch: Scratch) -> dict:
    base_prev, published = SN.working(spark, root), SN.current(spark, root)
    target, run_id = SN.snapshot_path(root, batch_id + 1), batch_id + 1
    if base_prev == target:  # this micro-batch was already applied (re-executed batch id)
        return {"batch_id": batch_id, "skipped": True}
    checkpoint_dir(spark)
    at = at or datetime.now(UTC)
    # C-7: feeds that are switched off are not taken in
    off = journals.where(~F.col("enabled")).select(F.col("id").alias("feed_id")).checkpoint(eager=True)
    batch = batch.join(bounded_broadcast(off), "feed_id", "left_anti").select(*batch.columns)
    # the bodies are not written again, only what the feed checks need
    landed = batch.select("feed_id", "seq", "etag", "last_modified", "not_modified").checkpoint(eager=True)
    catalogue = SN.fingerprint(rules, topics, gates, journals)

    def stored(name: str) -> DataFrame | None:
        return SN.read_table(spark, base_prev, name) if base_prev is not None else None

    def finish(tables: dict, checks: DataFrame, refused: DataFrame, found: DataFrame | None, n_items: int, **more) -> dict:
        """Writes, makes the snapshot the working one, and publishes it if the gate lets it pass. A refused snapshot keeps its items:
        the next batch builds on it."""
        run = R.run_row(run_id, checks, found if found is not None else spark.createDataFrame([], "outcome string")).withColumn(
            "items_applied", F.lit(n_items).cast("bigint"))
        # what was refused: bodies (no item_index), unusable items, and items that contradict a record
        refused = refused.select(*ITEM_KEY, "error_class", F.lit(run_id).cast("bigint").alias("run_id"))
        tables |= {"feed_state": FS.fold_state(stored("feed_state"), checks), "runs": SN.Change(run), "quarantine": SN.Change(refused)}
        SN.write_snapshot(tables, root, run_id, parent=base_prev)
        SN.note_catalogue(spark, target, catalogue)
        SN.keep_working(spark, root, target)
        report = SN.gate(spark, target, published)
        if report["publishable"]:
            SN.publish(spark, root, target)
        return {"batch_id": batch_id, "published": report["publishable"], **more, **report}

    parsed = scratch.keep(FD.parse_feeds(batch).withColumn("_row", F.monotonically_increasing_id()), "parsed")
    unreadable = parsed.where(F.col("error_class").isNotNull()).select("feed_id", "seq", "item_index", "error_class").checkpoint(eager=True)
    fresh_items, unusable = parsed, None
    if base_prev is not None:  # of items that were applied before only the errors count: their texts are not cleaned again
        applied = stored("applied_items").withColumnRenamed("journal_id", "feed_id")
        key = ["feed_id", "seq", "item_index"]
        seen = parsed.select(*key, "feed_url", "link", "error_class", "_row").join(applied, key, "left_semi").checkpoint(eager=True)
        n_seen = seen.count()
        if n_seen == parsed.where(F.col("error_class").isNull()).count():
            fresh_items = parsed.where("false")
        elif n_seen:
            fresh_items = parsed.join(bounded_broadcast(seen.select("_row")), "_row", "left_anti")
        unusable = FD.item_errors(seen, journals)
    events = FD.canonicalize(fresh_items.drop("_row"), journals)
    if enricher is not None:
        events = events.transform(enricher)
    events = scratch.keep(events.withColumn("_row", F.monotonically_increasing_id()), "events")
    scratch.drop("parsed")
    good = unrepeated(events)
    n_items = good.count()
    bad = events.where(F.col("error_class").isNotNull()).select(*ITEM_KEY, "error_class")
    unusable = (bad if unusable is None else bad.unionByName(unusable)).checkpoint(eager=True)
    bodies = unreadable.withColumnRenamed("feed_id", "journal_id")
    same_catalogue = base_prev is not None and SN.catalogue(spark, base_prev) == catalogue
    if same_catalogue and n_items == 0:
        # no new items (e.g. replayed bodies): articles, aliases and links are inherited from the
        # previous snapshot; only the feed state, the run ledger and the quarantine advance
        checks = FS.batch_checks(landed, unreadable, unusable).withColumn("run_id", F.lit(run_id)).checkpoint(eager=True)
        return finish({}, checks, bodies.unionByName(unusable), None, 0, no_change=True)

    old_arts = stored("articles")
    done = upsert(old_arts, stored("url_aliases"), _batch_items(good, batch_id), batch_id, at, scratch)
    clashes = good.withColumn("_order", order_key(batch_id)).join(done.rejected.withColumnRenamed("seq", "_order"), "_order", "left_semi").select(
        *ITEM_KEY, F.lit(K.CONFLICT).alias("error_class"))
    failed = unusable.unionByName(clashes).checkpoint(eager=True)
    # J-2 / F-2: feed validator state, folded batch over batch
    checks = FS.batch_checks(landed, unreadable, failed).withColumn("run_id", F.lit(run_id)).checkpoint(eager=True)
    of_uid = done.touched.withColumnRenamed("uid", "article_uid")
    if same_catalogue:
        # a touched entity's links become what the rules say of its merged row (H-7); the others stay
        moved = done.links(stored("article_tags"))
        fresh = T.replace_one(moved, done.folded.select("uid"), C.classify(done.folded, rules, topics, gates)).checkpoint(eager=True)
        links = SN.Change(fresh, "article_uid", of_uid)
        every = stored("article_tags").join(of_uid, "article_uid", "left_anti").select("tag_id").unionByName(fresh.select("tag_id"))
    else:  # another catalogue: every article is tagged anew
        links = C.classify(done.articles(old_arts), rules, topics, gates).checkpoint(eager=True)
        every = links.select("tag_id")
    tags = topics.select(F.col("topic_id").alias("id"), "label").join(every.select(F.col("tag_id").alias("id")).distinct(), "id", "left_semi")
    tables = {"articles": SN.Change(done.folded, "uid", done.touched), "article_tags": links, "tags": tags,
              "url_aliases": SN.Change(done.aliases.checkpoint(eager=True), "article_uid", of_uid),
              "applied_items": SN.Change(good.select(*ITEM_KEY)), "journals": journals}
    return finish(tables, checks, bodies.unionByName(failed), done.outcomes, n_items)


def run_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, journals: DataFrame,
               rules: DataFrame, topics: DataFrame, gates: DataFrame, enricher=None, source=None,
               clock: Callable[[], datetime] | None = None) -> list[dict]:
    """J-1: process everything landed so far, each body once, then stop.

    ``source`` (K-1) replaces the landing-folder stream with any streaming
    DataFrame of the ``raw_feeds`` shape. ``clock`` gives the time of each run
    (default: now).
    """
    reports: list[dict] = []
    stream = source if source is not None else spark.readStream.schema(FD.RAW_FEEDS_SCHEMA).parquet(landing)

    def each(batch_df: DataFrame, batch_id: int) -> None:
        reports.append(apply_batch(spark, batch_df, batch_id, root, journals, rules, topics, gates, enricher,
                                   clock() if clock is not None else None))

    with released_shuffles(spark):  # the stream runs in a copy of the session, made when it starts
        q = (stream.writeStream.foreachBatch(each).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).start())
        q.awaitTermination()
    return reports
