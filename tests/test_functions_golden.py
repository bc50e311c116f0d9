"""Per-row functions against the standard library and against values built from the rules."""

import html
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from litfeed.constants import HIDDEN_TAGS, SEPARATOR_TAGS, TRACKING_PARAMETERS
from litfeed.functions import articles as AF
from litfeed.functions.compose import nfc
from litfeed.functions.dates import normalize_date
from litfeed.functions.doi import BRACKETS, extract_doi, normalize_doi
from litfeed.functions.entities import unescape
from litfeed.functions.text import clean_text, visible_text
from litfeed.functions.url import normalize_url


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_references_as_the_standard_library_reads_them(spark):
    rnd = random.Random(1)
    names = rnd.sample(sorted(html.entities.html5), 60)
    values = ["", "&", "a&b;c", "&#;&#x;", "x&&amp;y"] + [f"p&{n}q" for n in names]
    values += [f"&#{rnd.choice([n, 0, 13, 128, 159, 55296, 1114112, 10 ** 12])};&#x{n:x}." for n in rnd.sample(range(32, 70000), 60)]
    assert apply(spark, values, unescape) == [html.unescape(v) for v in values]
    assert apply(spark, [None], unescape) == [None]


def test_composition_as_the_standard_library_does_it(spark):
    rnd = random.Random(2)
    letters = "éèñçüößåÅộậḗ aXyzĉ中ώйṩ"
    values = [unicodedata.normalize("NFD", "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 9)))) for _ in range(200)]
    values += ["́a", "Å", "ẹ́", "x́́", "̀"]
    assert apply(spark, values, nfc) == [unicodedata.normalize("NFC", v) for v in values]


@pytest.mark.parametrize("clean", [clean_text, visible_text])
def test_markup(spark, clean):
    cases = [(f"one<{t}>two</{t}>three", "one two three") for t in SEPARATOR_TAGS if t != "br"] + [("one<br/>two", "one two")]
    cases += [(f"one <{t} a='b'>gone &lt;p&gt;</{t}>two", "one two") for t in HIDDEN_TAGS]
    cases += [(f"one <{t}>never closed", "one") for t in HIDDEN_TAGS]
    cases += [("in<em>line</em> <x:b>mark</x:b>up", "inline markup"), ("<ns:p>a</ns:p><ns:p>b</ns:p>", "a b"), ("<!-- no --> yes <?pi?>", "yes"),
              ("<template>a<template>b</template>c</template>d", "d"), ("<style>a<style>b</style>c", "c"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
              ("&lt;b&gt;twice&lt;/b&gt;", "twice"), ("&amp;lt;i&amp;gt;escaped&amp;lt;/i&amp;gt;", "escaped"), (" \t  \n", None), ("", None),
              (None, None), ("Caf&eacute; &#8211; x", "Café – x")]
    assert apply(spark, [a for a, _ in cases], clean) == [b for _, b in cases]


def dois(seed, n):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        suffix = "".join(rnd.choice("AbcxZ019.-_;:+=@") for _ in range(rnd.randint(1, 8))) + "q"
        for _ in range(rnd.randint(0, 2)):
            o = rnd.choice(list(BRACKETS))
            at = rnd.randint(0, len(suffix) - 1)
            suffix = suffix[:at] + o + "in" + BRACKETS[o] + suffix[at:]
        out.append(f"10.{rnd.randint(1000, 999999999)}/{suffix}")
    return out


def test_dois_in_every_place(spark):
    plain = dois(3, 60)
    want = [d.lower() for d in plain]
    escape = lambda d: d.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    assert apply(spark, plain, normalize_doi) == want
    assert apply(spark, [f" DOI: {escape(d)} " for d in plain], normalize_doi) == want
    assert apply(spark, ["HTTPS://dx.doi.org/" + d.replace("(", "%28").replace("<", "%3C") + "?a=b" for d in plain if "+" not in d],
                 normalize_doi) == [w for w in want if "+" not in w]
    for tail in (".", ").", "],", '"!', "'?"):
        assert apply(spark, [f"as in ({escape(d)}{tail} More text" for d in plain], lambda c: normalize_doi(c, "free_text")) == want
    assert apply(spark, [f"https://journal.example/view/{d}?x#y" for d in plain if "<" not in d], lambda c: normalize_doi(c, "url_path")) == [
        w for w in want if "<" not in w]


def test_values_that_are_no_doi(spark):
    bad = [None, "", " ", "10.12/x", "10.1234/", "10.1234567890/x", "10.1234/a b", "10.1234/(a", "10.1234/a]b", "see 10.1234/a", "https://doi.org/x",
           "https://doi.org:port/10.1234/a", "https://else.example/10.1234/a", "10.1234/a​"]
    assert apply(spark, bad, normalize_doi) == [None] * len(bad)


def test_first_doi_of_an_item(spark):
    n = lambda v: F.lit(v).cast("string")
    df = spark.range(1)
    got = df.select(
        extract_doi(n("10.1000/A"), n("10.1000/b"), n(None), n(None), n(None), n(None)), extract_doi(n("bad"), n("doi:10.1000/b"), n(None), n(None), n(None), n(None)),
        extract_doi(n(None), n(None), n("tag:x"), n("10.1000/g"), n("10.1000/s"), n(None)),
        extract_doi(n(None), n(None), n(None), n(None), n("<p>At <b>10.1000/1097(199707)50:7&lt;601::AID-X&gt;3.0</b>.</p>"), n("http://a/10.1000/l")),
        extract_doi(n(None), n(None), n(None), n(None), n("none"), n("http://a/10.1000/l"))).first()
    assert tuple(got) == ("10.1000/a", "10.1000/b", "10.1000/g", "10.1000/1097(199707)50:7<601::aid-x>3.0", "10.1000/l")


def test_urls(spark):
    rnd = random.Random(4)
    plain = [f"https://h{rnd.randint(0, 9)}.example/p{rnd.randint(0, 99)}/é-{chr(rnd.randint(97, 122))}" for _ in range(20)]
    assert apply(spark, plain, normalize_url) == plain
    assert apply(spark, [u.replace("https", "HTTPS").replace(".example", ".EXAMPLE.:443") + "//#frag" for u in plain], normalize_url) == plain
    assert apply(spark, [f"\t{u}?{t}=1&a=%7e&utm_x=2&b=%2f&B " for u, t in zip(plain, TRACKING_PARAMETERS * 7)], normalize_url) == [
        u + "?a=~&b=%2F&B" for u in plain]
    # an escape may be any byte
    assert apply(spark, [f"http://a.b/%{i:02x}" for i in range(256)], normalize_url) == [
        "http://a.b/" + (chr(i) if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "-._~") else f"%{i:02X}") for i in range(256)]
    cases = [("http://straße.example", "http://strasse.example/"), ("http://[2001:DB8:0::1]:8080/", "http://[2001:db8::1]:8080/"), ("http://[1:2/", None),
             ("http://10.0.0.1:80/x/", "http://10.0.0.1/x"), ("http://10.0.0.999/", None), ("http://010.0.0.1/", None), ("http://a.b:70000/", None),
             ("http://a.b:x/", None), ("http://me@a.b/", None), ("http://a b.c/", None), ("http://a.b/\x07", None), ("mailto:a@b", None), ("//a.b/", None),
             ("http://-a.b/", None), ("http://a_b.c/", None), ("http:///x", None), ("", None), (None, None)]
    assert apply(spark, [a for a, _ in cases], normalize_url) == [b for _, b in cases]


def test_dates(spark):
    days = [f"{y}-{m:02d}-{d:02d}" for y, m, d in ((1900, 1, 1), (2024, 2, 29), (2100, 12, 31))]
    got = apply(spark, days + [f"{d}T10:20:30Z" for d in days] + ["1899-12-31", "2101-01-01", "2023-02-29", "soon", "", None],
                lambda c: F.date_format(normalize_date(c), "yyyy-MM-dd"))
    assert got == days * 2 + [None] * 6


def test_article_types(spark):
    cases = [("Book review", "review"), ("REVIEW  article", "review"), ("erratum to a review", "correction"), ("Letter", "research"),
             ("letter to the  editor", "editorial"), ("a news article", "other"), ("preview", "other"), ("<i>Corrigendum</i>", "correction"), ("", "other"),
             (None, "other")]
    assert apply(spark, [a for a, _ in cases], lambda c: AF.article_type(visible_text(c))) == [b for _, b in cases]
