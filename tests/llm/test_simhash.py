"""SimHash near-duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from litfeed.llm import simhash as H
from litfeed.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """component (smallest position) of each print"""
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return [find(i) for i in range(len(prints))]


def near(prints, rnd, n):
    out = list(prints)
    for _ in range(n):
        p = rnd.choice(out)
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            p ^= 1 << b
        out.append(p)
    return out


def test_fingerprints_and_components_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.near_duplicates(docs).collect()}
    given = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    prints = [brute_fingerprint(t) for _, t in given]
    roots = brute_components(prints)
    assert got == {d: (f"{p:016x}", given[r][0]) for (d, _), p, r in zip(given, prints, roots)}
    assert len(set(roots)) < len(roots)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_forest_against_brute_force(radius, monkeypatch):
    monkeypatch.setattr(H, "LANES", 32)
    rnd = random.Random(radius)
    prints = sorted(set(near([rnd.getrandbits(64) for _ in range(40)], rnd, 300)))
    links = H.forest(np.array(prints, np.uint64), radius)
    assert all((prints[a] ^ prints[b]).bit_count() >= 1 for a, b in links)
    up = list(range(len(prints)))
    for a, b in links:
        up[b] = a
    want = brute_components(prints, radius)
    assert len(links) == len(prints) - len(set(want))
    assert all(want[a] == want[b] for a, b in links)


def test_every_near_pair_shares_a_table():
    assert len(H.MASKS) == 28 and all(m.bit_count() == 48 for m in H.MASKS)
    for bits in combinations(range(64), 2):
        flipped = sum(1 << b for b in bits)
        assert any(not flipped & m for m in H.MASKS)


def test_search_over_clustered_prints(spark):
    rnd = random.Random(5)
    prints = sorted(set(near([rnd.getrandbits(64) for _ in range(60)], rnd, 1500)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(H.linked(df)).collect()}
    want = brute_components(prints)
    for a, b in combinations(range(0, len(prints), 7), 2):
        assert (got.get(signed[a], signed[a]) == got.get(signed[b], signed[b])) == (want[a] == want[b])


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark):
    df = spark.createDataFrame(
        [(4, None, 1), (2, "", 2), (9, " \t\n", 3), (7, "one two", 4), (3, "ONE  two", 5), (None, "one two", 6), (None, "alone here now", 7),
         (7, "one two", 8)], "doc_id long, text string, fp int")
    got = [tuple(r) for r in H.near_duplicates(df).collect()]
    assert sorted((d, c) for d, f, c in got if f == "0" * 16) == [(2, 2), (4, 2), (9, 2)]
    same = f"{brute_fingerprint('one two'):016x}"
    assert sorted(((d, c) for d, f, c in got if f == same), key=repr) == sorted([(7, 3), (7, 3), (3, 3), (None, 3)], key=repr)
    assert [c for d, f, c in got if f == f"{brute_fingerprint('alone here now'):016x}"] == [None]
    kept = H.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(2, "", 2), (3, "ONE  two", 5), (None, "alone here now", 7)], key=repr)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert H.near_duplicates(none).count() == 0 and H.deduplicated(none).count() == 0


def test_long_text_is_read_whole():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert H.fingerprint(text.encode()) == brute_fingerprint(text)
