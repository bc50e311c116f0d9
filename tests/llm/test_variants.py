"""Spelling variants: words, near words, forms and roots against brute force; tiles of any size; edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from litfeed.llm import variants as V
from litfeed.llm.sql import ORACLES
from litfeed.plans.verify import duck

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_words(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def model(words):
    masks = {}
    for w in words:  # candidates only: the word, and each of its letters left out
        for i in range(len(w)):
            masks.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
            masks.setdefault(w[:i] + w[i + 1:], set()).add(w)
        masks.setdefault(w, set()).add(w)
    near = {w: set() for w in words}
    for group in masks.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def result(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def run(spark, docs, schema="doc_id long, text string", **more):
    return result(V.grouped(V.counted(spark.createDataFrame(docs, schema)), **more))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = model(plain_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert result(V.grouped(V.counted(docs))) == want
    assert sum(r[2] > 0 for r in want) > 100 and any(r[3] for r in want)


def test_sql_twin_states_the_model():
    con = duck("/root/testdata/sf0.01")
    want = con.sql(ORACLES["op13_spelling_variants"]).select("word, n, n_near, form, form_n, root").fetchall()
    assert sorted(want) == model(plain_words(con.sql("SELECT doc_id, text FROM documents").fetchall()))


@pytest.mark.parametrize("tile", [1, 40, 300, 4096])
def test_tiles_of_any_size(spark, tile):
    rng = np.random.default_rng(tile)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(6, 9)))): int(rng.integers(5, 400)) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert result(V.grouped(df, tile=tile)) == model(words)


def test_single_edits_by_prefix_and_suffix():
    words = sorted({"aaaaaa", "aaaaaaa", "aaaaaaaa", "abaaaa", "abcdef", "abcdeg", "xbcdef", "abdef", "bcdefg", "abcxdef", "ßàéîõü", "ßàéîõ"})
    for w in words:
        for x in set(words) - {w}:  # words of a vocabulary are distinct
            size = max(len(w), len(x))
            rows = [pa.array([{"key": f"{size}p", "word": y, "n": 1}]) for y in (w, x)]
            i, _ = V.compared(V.Tile(rows[0]), V.Tile(rows[1]), False)
            assert (len(i) == 1) == one_edit(w, x), (w, x)


def test_a_key_of_many_words_is_many_block_pairs(spark):
    words = {f"common{a}{b}{c}": 5 for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    t = V.tiles(df, 200).collect()
    assert all(sum(len(r["word"]) for r in x["rows"]) <= 200 + 9 for x in t)
    assert result(V.grouped(df, tile=200)) == model(words)


def test_edge_cases(spark):
    long = "a" * 3000 + "b" * 3000
    docs = [(i, f"Kitten'Kittens {long} {long[1:]} sitting-sitting2sitting") for i in range(6)] + [(None, "Kitten kitten ÀÉÎÕÜß àÉÎÕÜß ÀÉÎÕÜß " * 3)] * 5
    docs += [(1, None), (2, ""), (3, "1234 日本語 \n\t"), (7, "Ａkitten×kitten÷kittens")]
    given = [(*d, "x", 1) for d in docs]
    df = spark.createDataFrame(given, "doc_id long, text string, word string, key int")
    want = model(plain_words(docs))
    assert result(V.grouped(V.counted(df))) == want and any(len(r[0]) > 5000 and r[2] for r in want)
    assert run(spark, []) == [] and run(spark, [(1, "no word often enough, words words")]) == []


def test_roots_follow_chains(spark):
    words = {"aaaaaa": 6, "baaaaa": 31, "bbaaaa": 160, "bbbaaa": 801, "bbbbaa": 4100, "bbbbba": 21000, "zzzzzzz": 9}
    got = result(V.grouped(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == model(words) and {r[5] for r in got} == {"bbbbba", "zzzzzzz"}
