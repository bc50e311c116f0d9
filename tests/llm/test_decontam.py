"""Containment search: SQL twin, brute force, lossless sketches, edge cases."""

import random
import re

from litfeed.llm import decontam as D
from litfeed.llm.sql import ORACLES
from litfeed.plans.verify import duck, rows_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k=None):
    """Shingles of k words; of an item: of five, or of all its words if these are fewer."""
    w = words(text)
    k = k or min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, items):
    out = []
    for d, t in docs:
        have = {k: shingles(t, k) for k in range(1, 6)}
        for i, q in items:
            want = shingles(q)
            if want and len(want & have[min(5, len(words(q)))]) >= 0.8 * len(want) - 1e-9:
                out.append((d, i, len(want & have[min(5, len(words(q)))]), len(want)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_sql_twin(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    got = D.contained(read("documents"), read("benchmark"))
    want = duck(SF).sql(ORACLES["op9_decontamination"])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def planted(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz") + rnd.choice("0123456789")
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 5, 6, 9, 20, 60, 200])))) for i in range(40)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rnd.randint(0, 400))]
        q = rnd.choice(items)[1].split()
        keep = int(len(q) * rnd.choice([0.5, 0.75, 0.85, 0.95, 1.0]))
        at = rnd.randint(0, len(w))
        q = [x.upper() + "," if rnd.random() < 0.5 else x for x in q[:keep]]
        if rnd.random() < 0.3 and q:  # one word changed
            q[rnd.randrange(len(q))] = "changed"
        docs.append((d, "\n".join(w[:at] + q + w[at:])))
    return docs, items


def test_partial_copies_against_brute_force(spark):
    docs, items = planted(1)
    got = D.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert found(got) == want and any(s < n for _, _, s, n in want)


def test_sketch_sizes_follow_the_partition(spark):
    _, items = planted(2)
    got = D.sketches(spark.createDataFrame([(i, t) for i, t in items], "item_row long, text string")).groupBy("item_row", "part").count()
    sizes = {i: len(shingles(t)) for i, t in items}
    top = {}
    for n in sizes.values():
        top[n.bit_length() - 1] = max(top.get(n.bit_length() - 1, 0), n)
    for r in got.collect():
        n = sizes[r["item_row"]]
        assert r["part"] == n.bit_length() - 1 and r["count"] == min(n, int(0.2 * top[r["part"]] + 1e-9) + 1)
        assert r["count"] > n - -(-n * 8 // 10)  # more values than shingles that may be missing


def test_items_of_fewer_than_five_words_are_found_in_longer_documents(spark):
    docs = [(1, "we read: Alpha beta, gamma delta and more words here"), (2, "alpha beta"), (3, "beta alpha gamma delta epsilon zeta"),
            (4, "alpha"), (5, None), (6, "gamma, DELTA!")]
    items = [(1, "alpha beta"), (2, "gamma delta"), (3, "alpha"), (4, "one two three four"), (5, "alpha beta gamma delta"), (6, "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in D.contained(d, i).collect())
    assert got == [(x, y, 1, 1) for x, y in sorted([(1, 1), (2, 1), (1, 2), (3, 2), (6, 2), (1, 3), (2, 3), (3, 3), (4, 3), (1, 5)])]


def test_texts_are_not_shuffled_to_their_candidates(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    plan = D.contained(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    monkeypatch.setattr(D, "FEW", 0)
    assert D.contained(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 1


def test_clean_keeps_other_documents_and_columns(spark):
    docs, items = planted(3)
    bad = {d for d, *_ in brute(docs, items)}
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id int, _row int")
    out = D.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [d for d, _ in docs if d not in bad] and bad


def test_edge_cases(spark):
    text = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, text), (3, text), (4, "short one"), (None, text), (5, "x " * 3000 + text + " y" * 3000)]
    items = [(10, text), (10, text), (11, None), (12, ""), (13, "short one"), (None, "short one")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(D.contained(d, i)) == brute(docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0))):
        assert D.contained(a, b).columns == ["doc_id", "item_id", "n_shared", "n_item", "containment"] and D.contained(a, b).count() == 0
    assert D.clean(d, i.limit(0)).count() == len(docs)
    # rows of one doc_id are told apart: only the row with the passage goes
    two = spark.createDataFrame([(1, text), (1, "clean text of its own here")], "doc_id long, text string")
    assert [r["text"] for r in D.clean(two, i).collect()] == ["clean text of its own here"]
