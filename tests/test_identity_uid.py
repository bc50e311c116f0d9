"""D-1 on stored rows: lookup against a plain model, lost aliases, rows that a UID unites, labels over chains."""

import random
from datetime import datetime

import pytest

from litfeed.operators import identity as I
from litfeed.session import checkpoint_dir
from litfeed.streaming import incremental as INC

ITEM = "seq long, doi string, url string, named_uid string, journal_id string"
ROW = "uid string, doi string, journal_id string, normalized_url string"


def plain(item, rows, aliases):
    seq, doi, url, named, journal = item
    by_uid = {r[0]: r for r in rows}
    found = [next((r for r in rows if doi is not None and r[1] == doi), None)]
    alias = by_uid.get(aliases.get(url))
    own = min((r for r in rows if url is not None and r[3] == url), default=None)
    found += [alias or own, by_uid.get(named)]
    found = [r for r in found if r]
    uids = list(dict.fromkeys(r[0] for r in found))
    dois = {r[1] for r in found} | {doi}
    conflict = len(dois - {None}) > 1 or any(r[2] != journal for r in found)
    return seq, uids[0] if uids else None, uids[1:], alias is None and own is not None, conflict


def test_lookup_against_a_plain_model(spark):
    rnd = random.Random(4)
    rows = [(f"u{i}", f"d{i}" if i % 3 else None, f"j{i % 2}", f"l{i}") for i in range(12)]
    aliases = {f"l{i}": f"u{i}" for i in range(12) if i % 4} | {f"m{i}": f"u{i}" for i in range(5)}
    pick = lambda p, n: rnd.choice([None, f"{p}{rnd.randrange(n)}"])
    items = [(s, pick("d", 14), rnd.choice([pick("l", 14), pick("m", 7)]), pick("u", 14), f"j{rnd.randrange(2)}") for s in range(300)]
    got = I.lookup(spark.createDataFrame(items, ITEM), spark.createDataFrame(rows, ROW),
                   spark.createDataFrame(list(aliases.items()), "normalized_url string, article_uid string")).collect()
    assert sorted((r.seq, r.uid, list(r.merges), r.repairs, r.conflict) for r in got) == [plain(i, rows, aliases) for i in items]
    assert sum(len(r.merges) > 0 and not r.conflict for r in got) > 3


def test_rows_united_over_chains_and_cycles(spark):
    checkpoint_dir(spark)
    rnd = random.Random(7)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", i) for i in range(70)]
    rnd.shuffle(chain)
    given = chain + [("b", "a", 1), ("a", "b", 2), ("z", "x", 1), ("z", "y", 5)]
    got = {r.uid: (r.root, r.since) for r in I.united(spark.createDataFrame(given, "loser string, survivor string, seq long")).collect()}
    assert {got[f"c{i:03d}"][0] for i in range(71)} == {"c070"}
    assert got["a"] == ("a", 1) and got["b"] == ("a", 1)
    assert [got[x] for x in "xyz"] == [("y", 1), ("y", 5), ("y", 1)]
    assert I.united(spark.createDataFrame([], "loser string, survivor string, seq long")).count() == 0


class Store:
    """Stored rows and aliases; each ``put`` is a batch."""

    def __init__(self, spark):
        checkpoint_dir(spark)
        self.spark, self.n, self.arts, self.alias = spark, 0, None, None

    def put(self, *items):
        rows = [(u, d, "j", t, a, ["A"], None, "research", "https://ex.org/x", url, "open", "https://ex.org/f", "rss_only", [], 1, i, "j")
                for i, (u, d, url, t, a) in enumerate(items)]
        ev = self.spark.createDataFrame(rows, "uid string, doi string, journal_id string, title string, abstract string, authors array<string>, "
                                        "published_at timestamp, article_type string, article_url string, normalized_url string, oa_status string, "
                                        "source_feed_url string, metadata_status string, enriched_fields array<string>, seq long, item_index int, feed_id string")
        new = INC._batch_items(ev, self.n).checkpoint(eager=True)
        done = INC.upsert(self.arts, self.alias, new, self.n, datetime(2026, 1, 1 + self.n))
        self.arts, self.alias = done.articles(self.arts).checkpoint(eager=True), done.url_aliases(self.alias).checkpoint(eager=True)
        self.n += 1
        self.done = done
        return sorted(r.outcome for r in done.outcomes.collect())

    def uids(self):
        return sorted(r.uid for r in self.arts.collect())

    def aliases(self):
        return {r.normalized_url: r.article_uid for r in self.alias.collect()}


A, B = ("url:a", None, "https://ex.org/a", "Alpha", "First"), ("url:b", None, "https://ex.org/b", "Beta", None)


@pytest.fixture
def store(spark):
    s = Store(spark)
    assert s.put(A, B) == ["inserted", "inserted"]
    s.a, s.b = s.aliases()["https://ex.org/a"], s.aliases()["https://ex.org/b"]
    return s


def test_own_url_repairs_a_lost_alias(store):
    store.alias = store.alias.where("normalized_url <> 'https://ex.org/a'").checkpoint(eager=True)
    assert store.put(("url:other", *A[1:])) == ["skipped"]
    assert store.uids() == sorted([store.a, store.b]) and store.aliases() == {"https://ex.org/a": store.a, "https://ex.org/b": store.b}


def test_a_uid_alone_finds_its_row(store):
    store.put((store.a, None, "https://ex.org/moved", "Alpha", "First"))
    assert store.uids() == sorted([store.a, store.b])
    assert store.aliases() == {"https://ex.org/a": store.a, "https://ex.org/moved": store.a, "https://ex.org/b": store.b}
    # both URLs stand for the row from now on
    assert store.put(("url:x", None, "https://ex.org/a", "Alpha", "Second")) == ["updated"]
    row = store.arts.where(f"uid = '{store.a}'").first()
    assert (row.abstract, row.normalized_url, store.arts.count()) == ("Second", "https://ex.org/a", 2)


def test_url_precedes_uid_and_both_rows_become_one(spark, store):
    store.alias = store.alias.where("normalized_url <> 'https://ex.org/b'").checkpoint(eager=True)
    assert store.put((store.a, None, "https://ex.org/b", "Beta", None)) == ["updated"]
    assert store.uids() == [store.b] and store.aliases() == {"https://ex.org/a": store.b, "https://ex.org/b": store.b}
    row = store.arts.first()  # what the survivor lacks comes from the other row
    assert (row.title, row.abstract, str(row.first_seen_at.date())) == ("Beta", "First", "2026-01-01")
    links = spark.createDataFrame([(store.a, "t1"), (store.b, "t2")], "article_uid string, tag_id string")
    assert sorted(tuple(r) for r in store.done.links(links).collect()) == [(store.b, "t1"), (store.b, "t2")]


def test_a_doi_joins_the_rows_that_url_and_uid_name(store):
    assert store.put((store.a, "10.1000/x", "https://ex.org/b", "Beta two", None)) == ["updated"]
    row = store.arts.first()
    assert (store.uids(), row.doi, row.title, row.abstract) == ([store.b], "10.1000/x", "Beta two", "First")


def test_rows_of_two_dois_are_a_conflict(store):
    store.put(("doi:1", "10.1000/1", "https://ex.org/1", "One", None), ("doi:2", "10.1000/2", "https://ex.org/2", "Two", None))
    before, one = store.uids(), store.aliases()["https://ex.org/1"]
    assert store.put((one, None, "https://ex.org/2", "Both", None)) == []
    assert store.uids() == before and store.done.rejected.count() == 1
