"""Feed bodies in three formats, bad bodies, oversize, binaryFile source (A-1..A-4)."""

import os

from litfeed.sources import feeds as FD

RSS2 = b"""<?xml version="1.0"?><rss version="2.0"><channel><title>T</title><link>https://j.example.org/</link>
<description>D</description>
<item><title>First &amp; best</title><link>/a/1</link><guid>10.1234/ABC</guid><pubDate>Wed, 01 Jul 2026 12:30:00 GMT</pubDate>
<description>&lt;p&gt;Hello&lt;/p&gt;</description><author>Ann</author></item>
<item><title>No link</title></item>
<item><title>Second</title><link>https://j.example.org/a/2</link></item>
</channel></rss>"""
RSS1 = b"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
 xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/">
<channel rdf:about="https://j.example.org/"><title>T</title><link>https://j.example.org/</link><description>D</description></channel>
<item rdf:about="https://j.example.org/a/3"><title>Third</title><link>https://j.example.org/a/3</link>
<dc:date>2026-07-01</dc:date><dc:creator>Bo</dc:creator><dc:creator>Cy</dc:creator><prism:doi>10.5555/X1</prism:doi>
<prism:section>Review</prism:section></item></rdf:RDF>"""
ATOM = b"""<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><id>urn:x</id><updated>2026-07-01T00:00:00Z</updated>
<entry><title>Fourth</title><link rel="alternate" href="https://j.example.org/a/4"/><id>urn:4</id>
<updated>2026-07-01T08:00:00+08:00</updated><author><name>Di</name></author><summary>See doi:10.7777/q.</summary></entry></feed>"""


def test_three_formats_and_errors(spark):
    rows = [("j", "https://j.example.org/feed", None, RSS2, None, None, False, 1),
            ("j", "https://j.example.org/feed", None, RSS1, None, None, False, 2),
            ("j", "https://j.example.org/feed", None, ATOM, None, None, False, 3),
            ("j", "https://j.example.org/feed", None, b"<rss><channel>", None, None, False, 4),
            ("j", "https://j.example.org/feed", None, b"<html/>", None, None, False, 5),
            ("j", "https://j.example.org/feed", None, None, None, None, True, 6)]
    raw = spark.createDataFrame(rows, FD.RAW_FEEDS_SCHEMA)
    out = {(r.seq, r.item_index): r for r in FD.parse_feeds(raw).collect()}
    assert out[(1, 0)].title == "First & best" and out[(1, 0)].link == "https://j.example.org/a/1"
    assert out[(1, 1)].title == "Second" and (1, 2) not in out
    assert out[(2, 0)].authors == ["Bo", "Cy"] and out[(2, 0)].prism_doi == "10.5555/X1"
    assert out[(3, 0)].link == "https://j.example.org/a/4" and out[(3, 0)].authors == ["Di"]
    assert out[(4, None)].error_class == "FeedParseError" and out[(5, None)].error_class == "FeedParseError"
    assert not any(k[0] == 6 for k in out)
    journals = spark.createDataFrame([("j", "https://j.example.org/feed")], "id string, feed_url string")
    ev = {(r.seq, r.item_index): r for r in FD.canonicalize(FD.parse_feeds(raw), journals).collect()}
    assert ev[(1, 0)].doi == "10.1234/abc" and ev[(1, 0)].abstract == "Hello"
    assert ev[(2, 0)].doi == "10.5555/x1" and ev[(2, 0)].article_type == "review"
    assert ev[(3, 0)].doi == "10.7777/q" and ev[(3, 0)].authors == ["Di"]
    assert str(ev[(3, 0)].published_at) == "2026-07-01 00:00:00"


def test_binary_file_source(spark, tmp_path):
    os.makedirs(tmp_path / "j")
    (tmp_path / "j" / "7.xml").write_bytes(RSS2)
    journals = spark.createDataFrame([("j", "https://j.example.org/feed")], "id string, feed_url string")
    raw = FD.read_body_files(spark, str(tmp_path), journals)
    items = FD.parse_feeds(raw).collect()
    assert sorted(r.title for r in items) == ["First & best", "Second"] and all(r.seq == 7 for r in items)


def test_raw_type_comes_from_the_section_or_the_type_never_from_a_category():
    from litfeed.sources.feeds import _entry_fields
    import xml.etree.ElementTree as ET
    item = lambda x: ET.fromstring(f"<item xmlns:prism='http://prismstandard.org/namespaces/basic/2.0/'>{x}</item>")
    assert _entry_fields(item("<category>Review</category>"), "rss2")["raw_type"] is None
    assert _entry_fields(item("<category>x</category><type>Review</type>"), "rss2")["raw_type"] == "Review"


def test_items_leave_the_parser_before_its_batch_ends():
    import pyarrow as pa
    big = RSS2.replace(b"Hello", b"H" * 300_000)
    rows = [dict(feed_id="j", feed_url="https://j.example.org/feed", effective_url=None, content=c, not_modified=False, seq=i)
            for i, c in enumerate([big] * 20 + [None, b"<html/>"])]
    schema = pa.schema([("feed_id", pa.string()), ("feed_url", pa.string()), ("effective_url", pa.string()), ("content", pa.binary()),
                        ("not_modified", pa.bool_()), ("seq", pa.int64())])
    out = list(FD._parse_batches(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])))
    assert len(out) >= 5 and max(b.nbytes for b in out) < 2 * FD.HELD_BYTES
    items = [r for b in out for r in b.to_pylist()]
    assert [(r["seq"], r["item_index"]) for r in items] == [(i, k) for i in range(20) for k in (0, 1)] + [(20, None), (21, None)]
    assert [r["error_class"] for r in items[-2:]] == ["FeedFetchError", "FeedParseError"]
