"""Source mixing: targets against a plain water-filling, rounding by its invariants (sum, expectation, bounds), reruns, edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from litfeed.llm import mixing as M

SCHEMA = "doc_id long, source string, text string"


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(size_of, weights=(1, 2, 3), most=3):
    """source -> target, by sharing the excess again and again."""
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(size_of.values())
    left, free = total, set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * size_of[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * size_of[s]
            left -= target[s]
        free -= over
    return target


def check(rows, given, slack=None):
    """The contract on result rows; ``slack``: source -> largest miss."""
    size_of, longest = defaultdict(int), defaultdict(int)
    for _, s, t in given:
        size_of[s] += n_words(t)
        longest[s] = max(longest[s], n_words(t))
    want = plain_targets(size_of)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((d, s, n_words(t)) for d, s, t in given)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size_of[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        ratio = want[r["source"]] / size_of[r["source"]] if size_of[r["source"]] else 0
        assert r["copies"] in (int(ratio + 1e-9), int(ratio + 1e-9) + 1) and r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size_of:
        assert abs(taken[s] - want[s]) <= (slack or longest)[s] + 1e-6, s


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    rows = M.mixed(docs).collect()
    per = defaultdict(list)
    for _, s, t in given:
        per[s].append(n_words(t))
    # what is left over at the end is no long document
    check(rows, given, {s: 0.02 * sum(v) for s, v in per.items()})


def test_reruns_agree_however_the_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def run(d):
        return sorted((r["doc_id"], r["taken"]) for r in M.mixed(d, fan=8, head=5).collect())
    assert run(docs) == run(docs.repartition(5, "lang")) == run(docs.orderBy("text"))


@pytest.mark.parametrize("fan", [2, 5, 1024])
def test_trees_of_any_fan(spark, fan):
    rng = np.random.default_rng(fan)
    given = [(i, "abc"[min(2, i % 7)], "w " * int(rng.integers(1, 60))) for i in range(150)]
    check(M.mixed(spark.createDataFrame(given, SCHEMA), fan=fan, head=fan).collect(), given)


def test_pivoted_keeps_sum_and_expectation():
    size = np.array([90.0, 40, 40, 7, 5, 3, 1])
    start = size * np.array([0.3, 0.5, 0.9, 0.25, 0.6, 0.1, 0.7])
    total, n = np.zeros(len(size)), 6000
    for seed in range(n):
        mass = start.copy()
        left = M.pivoted(size, mass, np.random.default_rng(seed))
        assert mass.sum() == pytest.approx(start.sum(), abs=1e-9)
        others = np.delete(np.arange(len(size)), left)
        assert all(mass[i] in (0, size[i]) for i in others) and 0 <= mass[left] <= size[left]
        total += mass
    assert np.allclose(total / n / size, start / size, atol=0.03)


def test_long_documents_against_the_rest():
    size, rest, part, n = np.array([500, 60, 40, 9]), 5000, 0.37, 6000
    total, after = np.zeros(len(size)), 0.0
    for seed in range(n):
        took, left = M.against_rest(size, part, rest, np.random.default_rng(seed))
        assert (took * size).sum() + left * rest == pytest.approx(part * (size.sum() + rest))
        total += took
        after += left
    assert np.allclose(total / n, part, atol=0.03) and after / n == pytest.approx(part, abs=0.02)
    # nothing follows: a draw; others too short: they give what they have
    alone = [M.against_rest(np.array([10]), 0.3, 0, np.random.default_rng(s))[0][0] for s in range(2000)]
    assert np.mean(alone) == pytest.approx(0.3, abs=0.04)
    # a giant that the others cannot make up for is left out, or taken, as the target wants
    assert not any(M.against_rest(np.array([10_000]), 0.08, 9_000, np.random.default_rng(s))[0][0] for s in range(50))
    assert all(M.against_rest(np.array([10_000]), 0.92, 9_000, np.random.default_rng(s))[0][0] for s in range(50))
    assert M.against_rest(np.array([100]), 0.6, 10, np.random.default_rng(1))[0][0]


def test_edge_cases(spark):
    given = [(1, "a", None), (2, "a", ""), (3, "a", " \n\t"), (4, None, "x y z"), (5, None, "x"), (6, "b", "one two"), (6, "b", "one two"),
             (6, "b", "one two"), (None, "é", "w " * 50), (8, "", "q"), (9, "long", "w " * 100_000), (10, "Z", "w " * 30)]
    df = spark.createDataFrame([(*g, 1, "x") for g in given], SCHEMA + ", size int, source_key string")
    check(M.mixed(df).collect(), given)
    assert M.mixed(df.limit(0)).collect() == []
    blank = M.mixed(df.filter("doc_id < 4")).collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0, 0)] * 3


def test_one_source_is_taken_once(spark):
    given = [(i, "only", "w " * i) for i in range(40)]
    rows = M.mixed(spark.createDataFrame(given, SCHEMA)).collect()
    assert {r["copies"] for r in rows} == {1}


def test_documents_are_copied_as_the_mix_says(spark):
    given = [(i, "ab"[i % 2], "w " * (i + 1)) for i in range(40)] + [(99, "c", "w")]
    docs = spark.createDataFrame([(*g, i) for i, g in enumerate(given)], SCHEMA + ", _copies int")
    mix = M.mixed(docs)
    got = Counter(r["doc_id"] for r in M.copied(docs, mix).select("doc_id").collect())
    assert got == Counter({r["doc_id"]: r["copies"] for r in mix.collect() if r["copies"]})
    assert M.copied(docs, mix).columns == docs.columns


def test_a_hot_source_is_split(spark):
    """A source of nearly all rows, equal sizes, is dealt out as nodes of the tree."""
    given = [(i, "hot" if i % 20 else "rare", "w " * 10) for i in range(4000)]
    rows = M.mixed(spark.createDataFrame(given, SCHEMA), fan=64, head=10).collect()
    check(rows, given)
