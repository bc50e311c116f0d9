"""Feed-body source (A-1 .. A-4, B-10 .. B-15, C-8, C-9).

Landed bodies ``raw_feeds(feed_id, feed_url, effective_url, content BINARY,
etag, last_modified, not_modified, seq)`` are parsed one body per row inside
``mapInArrow`` (stdlib ElementTree), emitting one row per kept entry with its
``item_index``, or one ``error_class`` row for an unusable body. Everything
after parsing is column expressions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.constants import MAX_FEED_BYTES
from litfeed.functions import articles as AF
from litfeed.functions.binding import let
from litfeed.functions.dates import normalize_date
from litfeed.functions.doi import extract_doi
from litfeed.functions.text import clean_text
from litfeed.functions.url import normalize_url
from litfeed.operators.util import bounded_broadcast, ensure_parallel

RAW_FEEDS_SCHEMA = ("feed_id string, feed_url string, effective_url string, content binary, etag string, "
                    "last_modified string, not_modified boolean, seq bigint")

ITEM_SCHEMA = ("feed_id string, feed_url string, seq bigint, item_index int, title string, link string, "
               "published string, prism_doi string, dc_identifier string, entry_id string, guid string, "
               "authors array<string>, summary string, raw_type string, error_class string")

# --- fixed values: XML namespaces of the three feed formats ---
NS_ATOM = "http://www.w3.org/2005/Atom"
NS_RSS1 = "http://purl.org/rss/1.0/"
NS_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NS_DC = "http://purl.org/dc/elements/1.1/"
NS_PRISM = "http://prismstandard.org/namespaces/basic/2.0/"


def _t(el) -> str | None:
    if el is None:
        return None
    txt = "".join(el.itertext()).strip()
    return txt or None


def _first(entry, *paths):
    for p in paths:
        v = _t(entry.find(p))
        if v is not None:
            return v
    return None


def _entry_fields(entry, fmt: str) -> dict:
    if fmt == "atom":
        a = f"{{{NS_ATOM}}}"
        link = None
        for ln in entry.findall(f"{a}link"):
            if ln.get("rel") in (None, "alternate") and ln.get("href"):
                link = ln.get("href").strip() or None
                break
        authors = [n for n in (_t(x.find(f"{a}name")) for x in entry.findall(f"{a}author")) if n]
        return dict(title=_t(entry.find(f"{a}title")), link=link,
                    published=_first(entry, f"{a}published", f"{a}updated", f"{{{NS_DC}}}date"),
                    summary=_first(entry, f"{a}summary", f"{a}content"), authors=authors,
                    entry_id=_t(entry.find(f"{a}id")), guid=None,
                    prism_doi=_t(entry.find(f"{{{NS_PRISM}}}doi")), dc_identifier=_t(entry.find(f"{{{NS_DC}}}identifier")),
                    raw_type=_first(entry, f"{{{NS_PRISM}}}section", f"{a}type", "type"))
    p = f"{{{NS_RSS1}}}" if fmt == "rss1" else ""
    authors = [n for n in (_t(x) for x in entry.findall(f"{{{NS_DC}}}creator")) if n]
    if not authors:
        one = _t(entry.find("author"))
        authors = [one] if one else []
    return dict(title=_t(entry.find(f"{p}title")), link=_t(entry.find(f"{p}link")),
                published=_first(entry, "pubDate", f"{{{NS_DC}}}date"),
                summary=_first(entry, f"{p}description"), authors=authors,
                entry_id=entry.get(f"{{{NS_RDF}}}about") if fmt == "rss1" else None, guid=_t(entry.find("guid")),
                prism_doi=_t(entry.find(f"{{{NS_PRISM}}}doi")), dc_identifier=_t(entry.find(f"{{{NS_DC}}}identifier")),
                raw_type=_first(entry, f"{{{NS_PRISM}}}section", f"{p}type", "type"))


#: A reference by name that XML does not define itself.
_NAMED = re.compile(rb"&(?!(?:amp|lt|gt|quot|apos);)([A-Za-z][A-Za-z0-9]*;)")


def parsed_root(content: bytes):
    """The root element. A body that breaks off, or breaks the rules further on, still gives the elements that were complete
    before: the parser is fed to where it stops, and what is open there is closed. References by HTML name are decoded."""
    content = _NAMED.sub(lambda m: html5.get(m[1].decode(), m[0].decode()).encode("ascii", "xmlcharrefreplace"), content)
    parser, open_tags, root = ET.XMLPullParser(("start", "end")), [], None
    try:
        parser.feed(content)
        parser.close()
    except ET.ParseError:
        pass
    try:
        for event, element in parser.read_events():
            root = element if root is None else root
            if event == "start":
                open_tags.append(element)
            else:
                open_tags.pop()
    except ET.ParseError:
        pass
    # an entry that was not complete is no entry
    for parent, child in zip(open_tags, open_tags[1:], strict=False):
        if child.tag.rsplit("}", 1)[-1] in ("item", "entry"):
            parent.remove(child)
    return root


def parse_body(content: bytes, base_url: str):
    """-> (list of entry dicts, error_class or None). Entries without title or link are skipped."""
    if content is None or len(content) > MAX_FEED_BYTES:
        return [], "FeedFetchError"
    root = parsed_root(content)
    if root is None:
        return [], "FeedParseError"
    tag = root.tag
    if tag == "rss" and (root.get("version") or "").strip() == "2.0":
        fmt, channel = "rss2", root.find("channel")
        entries = channel.findall("item") if channel is not None else []
        meta_ok = channel is not None and all(_t(channel.find(k)) for k in ("title", "link", "description"))
    elif tag == f"{{{NS_RDF}}}RDF":
        fmt, channel = "rss1", root.find(f"{{{NS_RSS1}}}channel")
        entries = root.findall(f"{{{NS_RSS1}}}item")
        meta_ok = channel is not None and all(_t(channel.find(f"{{{NS_RSS1}}}{k}")) for k in ("title", "link", "description"))
    elif tag == f"{{{NS_ATOM}}}feed":
        fmt = "atom"
        entries = root.findall(f"{{{NS_ATOM}}}entry")
        meta_ok = all(_t(root.find(f"{{{NS_ATOM}}}{k}")) for k in ("title", "id", "updated"))
    else:
        return [], "FeedParseError"
    if not entries and not meta_ok:
        return [], "FeedParseError"
    out = []
    for e in entries:
        f = _entry_fields(e, fmt)
        if f["title"] is None or f["link"] is None:
            continue
        f["link"] = urljoin(base_url, f["link"])
        out.append(f)
    return out, None


_ITEMS = pa.schema([("feed_id", pa.string()), ("feed_url", pa.string()), ("seq", pa.int64()), ("item_index", pa.int32())]
                   + [(c, pa.string()) for c in ("title", "link", "published", "prism_doi", "dc_identifier", "entry_id", "guid")]
                   + [("authors", pa.list_(pa.string())), ("summary", pa.string()), ("raw_type", pa.string()), ("error_class", pa.string())])

#: Items are handed on when the bodies they came from have so many bytes together, or when there are so many of them: what a
#: worker holds beside the batch it reads does not grow with the batch.
HELD_BYTES, HELD_ITEMS = 1 << 20, 2_000


def _parse_batches(batches):
    for batch in batches:
        columns = [batch.column(c) for c in ("feed_id", "feed_url", "effective_url", "seq", "content")]
        rows, held = [], 0
        for i in range(batch.num_rows):
            feed_id, feed_url, effective_url, seq, content = (c[i].as_py() for c in columns)
            entries, err = parse_body(content, effective_url or feed_url)
            of = dict(feed_id=feed_id, feed_url=feed_url, seq=seq, error_class=err)
            if err is not None:
                rows.append(of | dict(authors=[]))
            rows += [of | dict(item_index=k) | f for k, f in enumerate(entries)]
            held += len(content or b"")
            if held >= HELD_BYTES or len(rows) >= HELD_ITEMS:
                yield pa.RecordBatch.from_pylist(rows, schema=_ITEMS)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ITEMS)


def read_body_files(spark, path: str, catalogue: DataFrame) -> DataFrame:
    """A-1: landed body files ``<feed_id>/<seq>.xml`` read with the ``binaryFile``
    source and shaped as ``raw_feeds`` (feed URL from the catalogue)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path)
    parts = F.split(F.col("path"), "/")
    shaped = files.select(
        F.element_at(parts, -2).alias("feed_id"),
        F.regexp_extract(F.element_at(parts, -1), r"^([0-9]+)", 1).cast("bigint").alias("seq"),
        F.col("content"))
    cat = catalogue.select(F.col("id").alias("feed_id"), "feed_url")
    return shaped.join(bounded_broadcast(cat), "feed_id", "left").select(
        "feed_id", "feed_url", F.lit(None).cast("string").alias("effective_url"), "content",
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.lit(False).alias("not_modified"), "seq")


def parse_feeds(raw_feeds: DataFrame) -> DataFrame:
    """A-2/A-3/A-4: items (``error_class`` NULL) and unusable bodies (``error_class`` set).

    Oversized bodies are rejected in the JVM (``octet_length``) and never shipped
    to Python; 304 answers carry no body to parse.
    """
    bodies = raw_feeds.select("feed_id", "feed_url", "effective_url", "content", "not_modified", "seq")
    # a missing flag means that a body came
    bodies = bodies.where(~F.coalesce("not_modified", F.lit(False)))
    oversize = F.octet_length("content") > MAX_FEED_BYTES
    too_big = bodies.where(oversize).select(
        "feed_id", "feed_url", "seq", F.lit(None).cast("int").alias("item_index"),
        *[F.lit(None).cast("string").alias(c) for c in ("title", "link", "published", "prism_doi", "dc_identifier",
                                                        "entry_id", "guid")],
        F.array().cast("array<string>").alias("authors"), F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("raw_type"), F.lit("FeedTooLargeError").alias("error_class"))
    ok = bodies.where(~F.coalesce(oversize, F.lit(False)))
    return ensure_parallel(ok, "feed_id", "seq").mapInArrow(_parse_batches, ITEM_SCHEMA).unionByName(too_big)


def _with_catalogue(items: DataFrame, journals: DataFrame) -> DataFrame:
    j = journals.select(F.col("id").alias("feed_id"), F.col("feed_url").alias("catalog_feed_url"))
    return items.where(F.col("error_class").isNull()).join(bounded_broadcast(j), "feed_id", "left")


def _item_error():
    mismatch = F.col("catalog_feed_url").isNull() | (F.trim("feed_url") != F.trim("catalog_feed_url"))
    return F.when(mismatch, F.lit("FeedMismatchError")).when(F.col("normalized_url").isNull(), F.lit("UnusableUrlError"))


def item_errors(items: DataFrame, journals: DataFrame) -> DataFrame:
    """(journal_id, seq, item_index, error_class) of the items that ``canonicalize`` finds unusable: feed and link tell, no text is read."""
    x = _with_catalogue(items, journals).withColumn("normalized_url", normalize_url(F.col("link")))
    return x.withColumn("error_class", _item_error()).where(F.col("error_class").isNotNull()).select(
        F.col("feed_id").alias("journal_id"), "seq", "item_index", "error_class")


def canonicalize(items: DataFrame, journals: DataFrame) -> DataFrame:
    """B-15: raw items -> article events; unusable URL or feed mismatch -> ``error_class``."""
    x = _with_catalogue(items, journals)
    # all texts of an item in one array: the cleaning expression is large and planned once
    x = x.withColumn("texts", F.transform(F.concat(F.array("title", "summary", "raw_type"), F.coalesce("authors", F.array().cast("array<string>"))),
                                          clean_text))
    title = F.coalesce(F.get("texts", 0), F.lit("Untitled"))
    url = normalize_url(F.col("link"))
    doi = extract_doi(F.col("prism_doi"), F.col("dc_identifier"), F.col("entry_id"), F.col("guid"),
                      F.col("summary"), F.col("link"))
    doi = F.translate(doi, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    published = normalize_date(F.col("published"))
    authors = AF.distinct_authors(F.slice("texts", F.lit(4), F.greatest(F.size("texts"), F.lit(1))))
    events = x.select(
        "seq", "item_index", "feed_id", "feed_url", "catalog_feed_url",
        doi.alias("doi"), title.alias("title"), F.get("texts", 1).alias("abstract"),
        authors.alias("authors"), published.alias("published_at"),
        let(F.get("texts", 2), AF.article_type).alias("article_type"),
        F.trim("link").alias("article_url"), url.alias("normalized_url"),
        F.lit("unknown").alias("oa_status"), F.lit("rss_only").alias("metadata_status"),
        F.array().cast("array<string>").alias("enriched_fields"))
    events = events.withColumn("error_class", _item_error()).withColumn(
        "uid", AF.candidate_uid(F.col("doi"), F.col("normalized_url"), F.col("feed_id"), F.col("title"),
                                F.date_format("published_at", "yyyy-MM-dd")))
    return events.withColumnRenamed("feed_id", "journal_id").withColumnRenamed("catalog_feed_url", "source_feed_url")
