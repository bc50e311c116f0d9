"""Packing: ids against the tokenizer, windows against a plain best fit, edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from litfeed.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def plain_best_fit(lengths, window):
    free, out = [], []
    for n in lengths:
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        i = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(window)
        out.append((i, window - free[i]))
        free[i] -= n
    return sorted(free), out


def test_best_fit_decreasing_against_a_plain_search():
    rnd = random.Random(2)
    for window in (1, 7, 32, 100):
        for _ in range(60):
            lengths = sorted((rnd.randint(1, window) for _ in range(rnd.randint(0, 60))), reverse=True)
            got, free = K.best_fit(lengths, window), {}
            for (i, offset), n in zip(got, lengths):
                assert offset == window - free.get(i, window)
                free[i] = free.get(i, window) - n
                assert free[i] >= 0
            assert sorted(free.values()) == plain_best_fit(lengths, window)[0]


def test_tightest_window_of_the_tree():
    rnd, tree, open_at = random.Random(4), K.Capacities(64), []
    for i in range(3000):
        need = rnd.randint(1, 64)
        want = min((c for c in open_at if c >= need), default=-1)
        assert tree.tightest(need) == want
        if want >= 0 and rnd.random() < 0.6:
            tree.take(want)
            open_at.remove(want)
        else:
            c = rnd.randint(1, 64)
            tree.add(c, i)
            open_at.append(c)


def test_ids_are_those_of_the_tokenizer():
    enc, tok = K.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", " ", "a\n", "  a  b\n\n c\t\td ", "don't 's it's", "é è ñ 1a2 … 中文字符 \x00 \x1c", "x <|endoftext|> y", "\n" * 3000, "a" * 5000,
             " " * 5000 + "b"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [" ", "\t", "\n", "\r\n", "\u3000"])
def test_very_long_white_space(kind):
    """A million and five million characters; runs just below the switch are as fast."""
    enc, tok = K.Encoder(PATH), Tokenizer.from_file(PATH)
    for t in (kind * 10**6, "a" + kind * 10**6 + "b", (kind * (K.LONG_RUN // len(kind) - 1) + "a") * 200):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(enc.encode(kind * (5 * 10**6 // len(kind))))


def check(rows, docs, window=K.WINDOW):
    """rows of pack() with ids against documents (doc_id, text); returns the share of window places in use."""
    tok, by = Tokenizer.from_file(PATH), {}
    for r in rows:
        assert 0 < r["length"] <= window and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert set(by) == set(want)
    for d, parts in by.items():
        if len(want[d]) == 1:
            parts.sort(key=lambda r: r["start"])
            assert [x for r in parts for x in r["ids"]] == want[d][0]
            assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
            assert all(r["doc_tokens"] == len(want[d][0]) for r in parts)
        else:
            assert sum(r["length"] for r in parts) == sum(map(len, want[d]))
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    return sum(r["length"] for r in rows) / (len(windows) * window)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = K.pack(docs, PATH, with_ids=True).collect()
    assert check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()]) > 0.97


def test_very_long_white_space_through_spark(spark):
    """By pack(), and by the pipeline's last stage."""
    import corpus_pipeline
    given = [(1, " " * 10**6), (2, "a" + "\t" * 10**6 + "b"), (3, "plain words")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    check(K.pack(df, PATH, with_ids=True).collect(), given)
    docs = spark.createDataFrame([(*g, "en", "s", 1) for g in given], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3} and sum(r["length"] for r in got if r["doc_id"] == 1) == 10**6 + 1


def test_groups_pack_apart(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = K.pack(docs, PATH, with_ids=True).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_cases(spark):
    given = [(1, None), (2, ""), (3, "a"), (3, "b c"), (None, "null id"), (5, "word " * 5000), (6, "x" * 1023), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in given], "doc_id long, text string, row int, offset int")
    rows = K.pack(df, PATH, with_ids=True).collect()
    check(rows, given)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert K.pack(df.limit(0), PATH).count() == 0
