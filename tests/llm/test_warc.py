"""WARC bundles: exact round trip, seeking, revisits, SQL twin, edge cases."""

import base64
import hashlib

from litfeed.llm import warc as W
from litfeed.llm.sql import ORACLES
from litfeed.plans.verify import duck, rows_of

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of rows (page_id, url, html)."""
    by = {}
    for i, (p, _, h) in enumerate(rows):
        by.setdefault((h or "").encode(), []).append((p is not None, p or 0, -i))
    out = []
    for i, (p, _, h) in enumerate(rows):
        payload = (h or "").encode()
        top = max(by[payload])
        first = top[2] == -i
        out.append((p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit",
                    None if first or not top[0] else top[1]))
    return sorted(out, key=repr)


def records(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_pages_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    index = W.archive(pages).cache()
    got = W.read(index.select("bundle").distinct(), with_payload=True)
    want = {r["page_id"]: (r["url"], r["html"].encode()) for r in pages.collect()}
    assert {r["page_id"]: (r["url"], bytes(r["payload"])) for r in got.collect()} == want
    assert records(got) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_sql_twin(spark):
    got = W.round_trip(spark.read.parquet(f"{SF}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = duck(SF).sql(ORACLES["op4_warc"])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_copies_nulls_and_ties(spark):
    rows = [(1, "u1", "a"), (5, "u5", "a"), (5, "u5", "a"), (3, None, None), (4, "u4", ""), (None, "n", "a"), (None, "m", "only null"),
            (None, "m", "only null"), (9, "u\r\nX: y", "é" * 300_000), (10, "big", "é" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    assert records(W.round_trip(df)) == brute(rows)
    assert W.round_trip(df.limit(0)).count() == 0


def test_a_frame_is_found_by_the_seek_table(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", f"page {i} " * (i % 50 + 1) * 200) for i in range(400)]
    index = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).cache()
    assert index.select("bundle", "frame").distinct().count() > 2
    some = index.filter("page_id % 37 = 5")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in W.lookup(some).collect()}
    assert got == {i: h for i, _, h in rows if i % 37 == 5}


def test_any_reader_reads_a_bundle(spark):
    import zstandard
    rows = [(i, "u", f"text {i}" * 10_000) for i in range(40)]
    index = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).cache()
    path = index.first()["bundle"].removeprefix("file:")
    with open(path, "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert sum(1 for _ in W.parse(plain)) == 40
    store, p = W._store(path)
    with store.open_input_file(p) as f:
        table = W.seek_table(f)
        assert len(table) > 1 and b"".join(W.frame(f, table, k) for k in range(len(table))) == plain
