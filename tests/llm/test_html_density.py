"""HTML main text: pages of the tables, hand-made pages, edge cases."""

import html
import itertools
import math
import random
import re
import time

import pytest

from litfeed.llm.html_density import Page, extract, main_text

SF = "/root/testdata/sf0.001"
LONG = " ".join(["Plain words of an article go on and on."] * 12)


def article_of(source):
    """The article of a generated page, by its known markup."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    inner = re.sub(r"<[^<>]*\Z", "", re.sub(r"<footer.*", "", m[1] if m else "", flags=re.S))
    inner = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)[^>]*>", "\x01", inner)))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in inner.split("\x01")) if x)


def test_all_pages_of_a_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: (r["url"], article_of(r["html"])) for r in pages.collect()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in extract(pages).collect()}
    assert got == want


@pytest.mark.parametrize("noise", [
    "<nav><a href=x>Menu one</a><a href=y>Menu two</a></nav>", "<header><h1>Site name</h1><p>Slogan of it</p></header>",
    "<aside><p>" + LONG + "</p></aside>", "<div class='sidebar-left'><p>" + LONG + "</p></div>",
    "<div id=comments><p>" + LONG + "</p><p>" + LONG + "</p></div>", "<div class='cookie-notice'>We use cookies &amp; so on.</div>",
    "<div class='ad banner'>" + LONG + "</div>", "<form><p>Your name</p><input><button>Send</button></form>",
    "<script>var a = '<p>" + LONG + "</p>';</script>", "<style>p{content:'" + LONG + "'}</style>", "<!-- <p>" + LONG + "</p> -->",
    "<footer>&copy; someone &middot; imprint</footer>", "<div role=navigation><p>Home</p></div>", "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>",
    "<div hidden><p>" + LONG + "</p></div>"])
@pytest.mark.parametrize("wrap", ["<article><h1>Title</h1>{}</article>", "<div id=content><h1>Title</h1><div>{}</div></div>",
                                  "<main><section><h1>Title</h1>{}</section></main>"])
def test_noise_is_left_out(noise, wrap):
    body = wrap.format(f"<p>{LONG}</p><p>Second &amp; <b>bold</b>\n  part. {LONG}</p>")
    want = f"Title\n{LONG}\nSecond & bold part. {LONG}"
    assert main_text(f"<html><head><title>t</title></head><body>{noise}{body}</body></html>") == want
    assert main_text(f"<html><body>{body}{noise}</body></html>") == want


def test_article_in_two_parts():
    part = f"<p>{LONG}</p><p>{LONG}</p>"
    source = f"<body><nav><a>x</a></nav><div class=c><div class=p1>{part}</div><div class=p2>{part}</div></div><footer>f</footer></body>"
    assert main_text(source) == "\n".join([LONG] * 4)


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("no markup &amp; nothing", "no markup & nothing"), ("<p>a<p>b", "a\nb"), ("<p>a<br>b&nbsp;&nbsp;c", "a b c"),
    ("<p>cut off <b>bo", "cut off bo"), ("<p>text</p><p", "text"), ("<p>1 &lt; 2 &#233; &unknown; &am", "1 < 2 é &unknown; &am"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<script>x", ""), ("</p></div>x", "x"), ("<ul><li>a<li>b</ul>", "a\nb")])
def test_edges(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("source", ["<" * 50_000, "<a " * 50_000, '<a "' * 30_000, "<div>" * 20_000 + "x", "<b><p>" * 10_000,
                                    "&" * 50_000, "</p>" * 30_000, "<p>" + "word " * 200_000])
def test_broken_or_long_pages_take_linear_time(source):
    began = time.time()
    main_text(source)
    assert time.time() - began < 20


@pytest.mark.parametrize("source", ["<i>" * 20_000 + "</b>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000,
                                    "<i>" * 20_000 + "<hr>" * 20_000, "<i>" * 20_000 + "</section>" * 20_000, '<a x="' * 30_001,
                                    "<p title=it's " * 20_000, "<p ='" * 20_000])
def test_unmatched_end_tags_and_quotes_take_linear_time(source):
    began = time.time()
    main_text("<body><p>" + LONG + "</p>" + source)
    assert time.time() - began < 5


@pytest.mark.parametrize("source, want", [
    ("<p title=it's>Hello", "Hello"), ("<p title=it's class=a>Hello <b x='>'>you</b>", "Hello you"), ('<p a"b>Hello', "Hello"),
    ("<a href=/x?a='b'&c>link</a> text", "link text"), ('<p title="a>b" data-x=\'>\'>Hello', "Hello"), ("<p =x>Hello", "Hello")])
def test_quotes_inside_of_unquoted_values_are_no_quotes(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("name", ["related-work", "social-history", "notice-of-copyright", "comments-on-the-text", "search-strategy", "ad-hoc-methods"])
def test_parts_of_an_article_may_speak_of_furniture(name):
    part = f"<section class='{name}'><p>{LONG}</p></section>"
    assert main_text(f"<body><article><p>{LONG}</p>{part}</article></body>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["related", "share-buttons", "ad-slot", "newsletter-box", "comments", "cookie-notice", "sidebar-left", "ad-12"])
def test_furniture_inside_an_article_goes(name):
    assert main_text(f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article></body>") == LONG


def plain_densities(page):
    """Composite text density of every node by its definition, each from the whole list of texts; and the sums of the children's."""
    n = len(page.tag)

    def inside(i, top):  # below or at ``top``, with no noise on the way
        while i != top:
            if i <= 0 or page.noise[i]:
                return False
            i = page.parent[i]
        return True

    def values(top):
        mine = [i for i in range(n) if inside(i, top)]
        runs = [r for r in page.runs if r[0] in mine]
        return (sum(len("".join(t.split())) for _, _, t, _ in runs), sum(x for *_, x in runs), len(mine) - 1, sum(page.links[i] for i in mine))

    body = page.tag.index("body") if "body" in page.tag else 0
    c_body, l_body, _, _ = values(body)

    def density(c, lc, t, lt):
        if not c:
            return 0
        t += lt
        base = math.log(math.log(c / max(1, c - lc) * lc + l_body / max(1, c_body) * c + math.e))
        return c / max(1, t) * math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / max(base, 0.1)

    dense = [0 if page.noise[i] else density(*values(i)) for i in range(n)]
    total = [sum(dense[j] for j in range(1, n) if page.parent[j] == i) for i in range(n)]
    for (node, _), group in itertools.groupby(page.runs, lambda r: r[:2]):
        group = list(group)
        lc = sum(x for *_, x in group)
        total[node] += density(sum(len("".join(t.split())) for _, _, t, _ in group), lc, 0, 1 if lc else 0)
    return dense, total


def test_densities_sums_and_threshold_against_the_definition():
    rnd = random.Random(6)

    def made(depth):
        out = []
        for _ in range(rnd.randint(1, 4)):
            words = " ".join(["word"] * rnd.randint(0, 30))
            kind = rnd.choice(["p", "div", "a", "b", "nav", "ul", "section", "text"])
            inner = made(depth - 1) if depth and kind in ("div", "section", "nav") else words
            out.append(inner + " " if kind == "text" else f"<{kind}>{inner}</{kind}>")
        return "".join(out)
    for _ in range(60):
        page = Page(f"<html><body>{made(3)}</body></html>")
        page.chosen()
        dense, total = plain_densities(page)
        assert page.dense == pytest.approx(dense) and page.total == pytest.approx(total)
        assert total[page.best] == pytest.approx(max(total))
        path = [page.best]
        while page.tag[path[-1]] not in ("body", "#root"):
            path.append(page.parent[path[-1]])
        assert page.threshold == pytest.approx(min(dense[i] for i in path))


def test_density_prefers_text_over_links():
    page = Page("<body><div><a href=1>a long link text here</a><a>another long link text</a></div><div><p>" + LONG + "</p></div></body>")
    assert page.text() == LONG


@pytest.mark.parametrize("attribute", ['href="/en/hidden-costs"', "href=/en/hidden", 'title="the hidden part"', 'data-hidden="false"',
                                       "data-role=navigation", "data-id='sidebar'", "title='class=footer'"])
def test_names_of_noise_in_values_or_data_attributes_are_none(attribute):
    source = f"<body><div><p>{LONG} <a {attribute}>the link</a> ends.</p><div {attribute}><p>{LONG}</p></div></div></body>"
    assert main_text(source) == f"{LONG} the link ends.\n{LONG}"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=c>{}</div>"])
def test_short_parts_beside_a_long_one_are_kept(wrap):
    many = "".join(f"<p>{LONG}</p>" for _ in range(20))
    parts = ["<h1>Title</h1>", "<p>The lead of it.</p>", f"<div>{many}</div>", "<h2>Further</h2>", "<ul><li>One point<li>Another point</ul>",
             "<pre>a = 1</pre>", "<table><tr><td>cell</table>", "<blockquote>Said so.</blockquote>", "bare text here", "<p>The closing.</p>"]
    want = ["Title", "The lead of it.", *[LONG] * 20, "Further", "One point", "Another point", "a = 1", "cell", "Said so.",
            "bare text here", "The closing."]
    menu = "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    assert main_text(f"<body>{menu}{wrap.format(''.join(parts))}{menu}</body>").split("\n") == want


def test_lists_of_references_in_an_article_are_kept():
    source = f"<article><p>{LONG}</p><p>{LONG}</p><ul><li><a href=a>First source</a><li><a href=b>Second source</a></ul></article>"
    assert main_text(f"<body>{source}</body>") == f"{LONG}\n{LONG}\nFirst source\nSecond source"


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "y")],
                               "page_id long, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", ""), (1, "u", ""), (None, None, "a")], key=repr)
    assert extract(df.limit(0)).count() == 0
