"""Set-based rounds against a walk over the items in order (H-9)."""

import random

from litfeed.operators import conflicts as K


def walk(items, fixed=()):
    """seqs that contradict what an earlier accepted item (or a stored record) fixed."""
    stands, bad = {(k, key): v for k, key, v in fixed}, set()
    for seq, url, doi, journal in sorted(items):
        said = {("url_journal", url): journal, ("doi_journal", doi): journal, ("url_doi", url): doi}
        said = {k: v for k, v in said.items() if k[1] is not None and v is not None}
        if any(stands.get(k, v) != v for k, v in said.items()):
            bad.add(seq)
        else:
            stands.update(said)
    return bad


def run(spark, items, fixed=None):
    df = spark.createDataFrame(items, "seq long, url string, doi string, journal_id string")
    known = spark.createDataFrame(fixed, "kind string, key string, value string") if fixed else None
    return {r.seq for r in K.contradictions(df, known).collect()}


def test_random_histories(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        items = [(i, f"u{rnd.randrange(6)}", rnd.choice([None, f"d{rnd.randrange(5)}"]), f"j{rnd.randrange(3)}") for i in range(60)]
        want = walk(items)
        assert run(spark, items) == want and 0 < len(want) < len(items)


def test_stored_records_come_first(spark):
    items = [(1, "x", "a", "j1"), (2, "x", "b", "j1"), (3, "y", "a", "j2"), (4, "y", None, "j2")]
    assert run(spark, items) == walk(items) == {2, 3}
    fixed = [("url_doi", "x", "b"), ("doi_journal", "a", "j2")]
    assert run(spark, items, fixed) == walk(items, fixed) == {1}


def test_rejected_items_fix_nothing(spark):
    # 2 is rejected for x, so y stays free for 3
    items = [(1, "x", "a", "j1"), (2, "x", "b", "j2"), (3, "z", "b", "j3"), (4, "z", "b", "j2")]
    assert run(spark, items) == {2, 4}


def test_no_conflict_no_work(spark):
    assert run(spark, [(1, "x", "a", "j"), (2, "y", "a", "j"), (3, "x", None, "j")]) == set()
    assert run(spark, []) == set()
