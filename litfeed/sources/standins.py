"""Driver tables re-read as the feed data model (stand-in views).

Each builder reads the landed parquet tables, so its work grows with them.
The DuckDB twin of every view lives in ``litfeed.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litfeed.constants import PUBLISHERS

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table. ``<dir>?replicate=<k>`` replicates keyed tables k times
    (bench only): each row becomes k rows with ``doc_id*k + r`` (a generator, no join),
    so every derived view grows k-fold, hot keys included."""
    base, _, opt = sf_dir.partition("?replicate=")
    df = spark.read.parquet(f"{base}/{name}.parquet")
    k = int(opt) if opt else 1
    if k > 1 and "doc_id" in df.columns:
        cols = [c for c in df.columns if c != "doc_id"]
        # spread the 1x rows first (a small shuffle), then generate the copies in parallel
        df = df.repartition(spark.sparkContext.defaultParallelism * 2, "doc_id")
        df = df.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_r"), *df.columns).select(
            (F.col("doc_id") * k + F.col("_r")).alias("doc_id"), *cols)
    return df


def _choose(key: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``articles`` snapshot: documents LEFT JOIN labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    d = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc:"), d.cast("string")).alias("uid"),
        F.when(d % 4 != 0, F.concat(F.lit("10.5555/d"), d.cast("string"))).alias("doi"),
        F.col("source").alias("journal_id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("abstract"),
        F.when(d % 17 != 0, F.timestamp_seconds(F.lit(EPOCH_2024) + F.expr("doc_id div 3") * 3600)).alias("published_at"),
        _choose(d % 5, ("research", "review", "editorial", "correction", "other")).alias("article_type"),
        F.concat(F.lit("https://ex.org/a/"), d.cast("string")).alias("article_url"),
        F.when(F.col("quality") == 1, "open").when(F.col("quality") == 0, "closed").otherwise("unknown").alias("oa_status"),
    )


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = read(spark, sf_dir, "documents").select("source").distinct()
    num = F.substring("source", 4, 10).cast("bigint")
    return src.select(
        F.col("source").alias("id"),
        F.concat(F.lit("Journal "), "source").alias("name"),
        _choose(num % 8, PUBLISHERS).alias("publisher"),
        F.concat(F.lit("https://feeds.example.org/"), "source", F.lit(".xml")).alias("feed_url"),
        (num % 7 != 0).alias("enabled"),
    )


_STATUS = {"click": "ok", "purchase": "ok", "view": "not_modified", "signup": "partial", "error": "error"}


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed checks: one event = one conditional fetch of feed ``f<user_id>``."""
    ev = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type").isin("click", "purchase"), "ok") \
        .when(F.col("event_type") == "view", "not_modified") \
        .when(F.col("event_type") == "signup", "partial") \
        .when(F.col("event_type") == "error", "error")
    return ev.select(
        F.col("event_id").alias("seq"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("run_id"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("feed_id"),
        F.col("ts").alias("checked_at"),
        status.alias("status"),
        F.when(k % 3 != 0, F.concat(F.lit('W/"'), k.cast("string"), F.lit('"'))).alias("etag"),
        F.when(k % 2 == 0, F.concat(F.lit("lm"), (k % 10).cast("string"))).alias("last_modified"),
        F.when(status.isin("error", "partial"), F.concat(F.lit("E"), F.col("event_type"))).alias("error"),
        (k % 7).alias("n_items"),
        F.when(status == "partial", 1 + k % 3).otherwise(0).alias("item_errors"),
    )


def items(spark: SparkSession, sf_dir: str, conflict: bool = False) -> DataFrame:
    """Article item history (one row per normalised feed item, ordered by ``seq``).

    Each URL carries at most one DOI; a DOI has several URLs; ``doi_no % 8 = 7``
    gives URL-only entities. ``conflict=True`` adds a second DOI on some URLs
    and a second journal on some DOIs.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col("doc_id")
    url_no = (d * 7) % 200
    doi_no = url_no % 80
    doi = F.when((d % 3 != 0) & (doi_no % 8 != 7), F.concat(F.lit("10.5555/"), doi_no.cast("string")))
    journal = F.concat(F.lit("src"), (doi_no % 20).cast("string"))
    if conflict:
        doi = F.when((url_no % 50 == 0) & (d % 3 == 1) & doi.isNotNull(),
                     F.concat(F.lit("10.6666/"), doi_no.cast("string"))).otherwise(doi)
        journal = F.when((doi_no % 40 == 0) & (d % 3 == 2), F.lit("src99")).otherwise(journal)
    title = F.when(d % 5 == 0, F.lit("N/A")).otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    abstract = F.when(d % 7 == 0, F.lit("No abstract")).otherwise(F.col("text"))
    atype = _choose(d % 6, ("research", "other", "review", "other", "editorial", "correction"))
    oa = _choose(d % 4, ("open", "unknown", "closed", "unknown"))
    has_doi = doi.isNotNull()
    return docs.select(
        d.alias("seq"),
        F.concat(F.lit("https://ex.org/"), url_no.cast("string")).alias("url"),
        doi.alias("doi"),
        journal.alias("journal_id"),
        title.alias("title"),
        abstract.alias("abstract"),
        F.when(d % 11 != 0, F.timestamp_seconds(F.lit(EPOCH_2024) + d * 86400)).alias("published_at"),
        atype.alias("article_type"),
        oa.alias("oa_status"),
        F.when(has_doi & (d % 4 == 0), "enriched").when(has_doi & (d % 6 == 1), "partial").otherwise("rss_only").alias("metadata_status"),
        (has_doi & (d % 4 == 0)).alias("enriched"),
    )


def raw_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs plus one rule-based variant of each (case, ports, escapes,
    tracking parameters, userinfo, other schemes) for URL canonicalisation."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    sep = F.when(u.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    k = F.col("page_id") % 5
    variant = (
        F.when(k == 0, F.replace(F.replace(F.replace(u, F.lit("https://"), F.lit("HTTPS://")), F.lit(".example."), F.lit(".EXAMPLE.")),
                                 F.lit(".com/"), F.lit(".com:443/")))
        .when(k == 1, F.concat(u, sep, F.lit("Gclid=1&keep=%7e%2f&utm_Medium=x&UTM%5Fterm=y&spm=q")))
        .when(k == 2, F.replace(F.replace(u, F.lit("/en/"), F.lit("/en/%61%2f%7E/")), F.lit(".org/"), F.lit(".org.:8080/")))
        .when(k == 3, F.replace(u, F.lit("://"), F.lit("://user@")))
        .otherwise(F.replace(F.replace(u, F.lit("https://"), F.lit("ftp://")), F.lit("http://"), F.lit("http://a..b.")))
    )
    return p.select("page_id", u.alias("raw_url")).unionByName(
        p.select((F.col("page_id") + 1_000_000_000).alias("page_id"), variant.alias("raw_url")))


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written as feed date strings in several layouts."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts")
    e = F.col("event_id")
    ts = F.col("ts")
    txt = (
        F.when(e % 6 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(e % 6 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(e % 6 == 2, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(e % 6 == 3, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0500")))
        .when(e % 6 == 4, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("week "), e.cast("string")))
    )
    txt = F.when(e % 17 == 0, F.replace(txt, F.lit("2024"), F.lit("1899"))).otherwise(txt)
    return ev.select("event_id", txt.alias("raw_date"))


def raw_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw article-type strings: a type phrase chosen by rule plus words of the document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    phrases = ("Research Article", "News Article", "Review article", "Correction to a News Article",
               "Letter to the Editor", "Preview", "Commentary", "Erratum", "letter", "Perspective piece")
    d = F.col("doc_id")
    phrase = _choose(d % len(phrases), phrases)
    return docs.select(d.alias("doc_id"), F.concat(phrase, F.lit(" "), F.col("text")).alias("raw_type"))


def _doi_no(d: Column) -> Column:
    return ((d * 7) % 200) % 80


def _payload_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest document per item DOI number, as the basis of landed service responses."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.groupBy(_doi_no(F.col("doc_id")).alias("doi_no")).agg(
        F.max_by("text", "doc_id").alias("text"), F.max("doc_id").alias("doc_id"))


def crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed bibliographic responses ``(doi, http_status, payload)``, one per DOI."""
    p = _payload_source(spark, sf_dir)
    n = F.col("doi_no")
    words = F.split(F.substring("text", 1, 40), " ", -1)
    title = F.substring("text", 1, 30)
    author = F.struct(F.try_element_at(words, F.lit(1)).alias("given"), F.try_element_at(words, F.lit(2)).alias("family"),
                      F.lit(None).cast("string").alias("name"))
    org = F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"),
                   F.lit("Anonymous").alias("name"))
    msg_even = F.struct(F.array(F.lit("N/A"), title).alias("title"), F.array(author, org, author).alias("author"),
                        F.concat(F.lit("<p>"), F.substring("text", 1, 80), F.lit("</p>")).alias("abstract"),
                        _choose(n % 3, ("journal-article", "review-article", "other")).alias("type"))
    msg_odd = F.struct(title.alias("title"), F.array(org).alias("author"),
                       F.lit("Abstract unavailable").alias("abstract"),
                       _choose(n % 3, ("journal-article", "review-article", "other")).alias("type"))
    payload = (F.when(n % 10 == 3, F.lit("not json"))
               .when(n % 10 == 6, F.lit('{"message": "x"}'))
               .when(n % 2 == 0, F.to_json(F.struct(msg_even.alias("message"))))
               .otherwise(F.to_json(F.struct(msg_odd.alias("message")))))
    return p.select(F.concat(F.lit("10.5555/"), n.cast("string")).alias("doi"),
                    F.when(n % 9 == 4, 404).otherwise(200).alias("http_status"), payload.alias("payload"))


def unpaywall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed open-access responses; one DOI in four has none, one answers a string."""
    p = _payload_source(spark, sf_dir).where(F.col("doi_no") % 4 != 3)
    n = F.col("doi_no")
    payload = (F.when(n % 4 == 0, F.lit('{"is_oa": true}')).when(n % 4 == 1, F.lit('{"is_oa": false}'))
               .otherwise(F.lit('{"is_oa": "yes"}')))
    return p.select(F.concat(F.lit("10.5555/"), n.cast("string")).alias("doi"), F.lit(200).alias("http_status"),
                    payload.alias("payload"))


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as article records before enrichment (with authors and provenance)."""
    i = items(spark, sf_dir)
    s = F.col("seq")
    authors = F.when(s % 2 == 0, F.array(F.lit("et al."))).otherwise(F.array(F.substring("title", 1, 8)))
    return i.withColumn("authors", authors).withColumn(
        "enriched_fields", F.when(F.col("enriched") & (F.col("title") != "N/A"), F.array(F.lit("title")))
        .otherwise(F.array().cast("array<string>")))


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


FEED_GROUP = 8  # entries per landed body: bodies stay small however large the corpus


def raw_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed feed bodies built from ``documents``: one body per (source, block of
    8 documents), alternating RSS 2.0 / RSS 1.0 / Atom; some bodies are
    truncated (malformed) and some answer 304 (not modified)."""
    from litfeed.operators.util import ensure_parallel
    docs = ensure_parallel(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    d = F.col("doc_id")
    grp = F.floor(d / FEED_GROUP)
    title = _xml_escape(F.split_part("text", F.lit("\n"), F.lit(1)))
    summary = _xml_escape(F.concat(
        F.lit("<p>"), F.col("text"),
        F.when(d % 4 == 1, F.concat(F.lit(" See doi: 10.5555/S"), d.cast("string"), F.lit(".)"))).otherwise(F.lit("")),
        F.lit("</p>")))
    link = F.when(d % 3 == 0, F.concat(F.lit("/a/"), d.cast("string"), F.lit("?utm_source=feed")))\
        .otherwise(F.concat(F.lit("https://ex.org/a/"), d.cast("string")))
    no_title = d % 29 == 0
    date_rfc = F.date_format(F.timestamp_seconds(F.lit(EPOCH_2024) + d * 3600), "EEE, dd MMM yyyy HH:mm:ss")
    date_iso = F.concat(F.date_format(F.timestamp_seconds(F.lit(EPOCH_2024) + d * 3600), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    doi_el = F.when(d % 5 == 0, F.concat(F.lit("<prism:doi>10.5555/P"), d.cast("string"), F.lit("</prism:doi>"))).otherwise(F.lit(""))
    fmt = F.col("fmt")
    rss2 = F.concat(F.lit("<item>"), F.when(no_title, F.lit("")).otherwise(F.concat(F.lit("<title>"), title, F.lit("</title>"))),
                    F.lit("<link>"), link, F.lit("</link><guid>g"), d.cast("string"), F.lit("</guid><pubDate>"), date_rfc,
                    F.lit(" GMT</pubDate><description>"), summary, F.lit("</description><author>A. Writer</author>"),
                    doi_el, F.lit("<type>Research Article</type></item>"))
    rss1 = F.concat(F.lit('<item rdf:about="https://ex.org/a/'), d.cast("string"), F.lit('">'),
                    F.when(no_title, F.lit("")).otherwise(F.concat(F.lit("<title>"), title, F.lit("</title>"))),
                    F.lit("<link>"), link, F.lit("</link><dc:date>"), date_iso, F.lit("</dc:date><dc:creator>B. One</dc:creator>"),
                    F.lit("<dc:creator>b. one</dc:creator><description>"), summary, F.lit("</description>"), doi_el,
                    F.lit("<prism:section>Review</prism:section></item>"))
    atom = F.concat(F.lit("<entry>"), F.when(no_title, F.lit("")).otherwise(F.concat(F.lit("<title>"), title, F.lit("</title>"))),
                    F.lit('<link rel="alternate" href="'), link, F.lit('"/><id>urn:doc:'), d.cast("string"),
                    F.lit("</id><updated>"), date_iso, F.lit("</updated><summary>"), summary,
                    F.lit("</summary><author><name>C. Two</name></author>"), doi_el, F.lit("</entry>"))
    per = docs.withColumn("grp", grp).withColumn("fmt", F.col("grp") % 3).withColumn(
        "xml", F.when(fmt == 0, rss2).when(fmt == 1, rss1).otherwise(atom))
    bodies = per.groupBy("source", "grp", "fmt").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "xml"))), lambda x: x["xml"]), "").alias("inner"))
    ns = (' xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/"')
    head2 = F.lit(f'<?xml version="1.0"?><rss version="2.0"{ns}><channel><title>T</title><link>https://ex.org/</link><description>D</description>')
    head1 = F.lit(f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"{ns}>'
                  '<channel rdf:about="https://ex.org/"><title>T</title><link>https://ex.org/</link><description>D</description></channel>')
    heada = F.lit(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"{ns}><title>T</title><id>urn:f</id><updated>2024-01-01T00:00:00Z</updated>')
    body = (F.when(fmt == 0, F.concat(head2, F.col("inner"), F.lit("</channel></rss>")))
            .when(fmt == 1, F.concat(head1, F.col("inner"), F.lit("</rdf:RDF>")))
            .otherwise(F.concat(heada, F.col("inner"), F.lit("</feed>"))))
    body = F.when(F.col("grp") % 11 == 5, F.substring(body, 1, 200)).otherwise(body)
    g = F.col("grp")
    return bodies.select(
        F.col("source").alias("feed_id"),
        F.concat(F.lit("https://feeds.example.org/"), "source", F.lit(".xml")).alias("feed_url"),
        F.when(g % 2 == 0, F.concat(F.lit("https://mirror.example.org/"), "source", F.lit("/feed.xml"))).alias("effective_url"),
        F.encode(body, "UTF-8").alias("content"),
        F.concat(F.lit('W/"'), g.cast("string"), F.lit('"')).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        (g % 13 == 7).alias("not_modified"),
        g.cast("bigint").alias("seq"))
