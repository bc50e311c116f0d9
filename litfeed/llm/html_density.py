"""Main-text extraction from HTML by composite text density.

Every element that is not inline is a node. Its composite density is its characters per tag, adjusted by links:
``C/T * log_b(C/LC * T/LT)`` with ``b = ln(C/(C-LC) * LC + LCb/Cb * C + e)``, where C counts characters and T tags of the
subtree, LC and LT those of links, and b marks the body (a count of zero is taken as one). A node's density sum adds up
the densities of its children and of its own stretches of text. The subtree with the largest sum leads to the main text: the
article (or main) element around it, else itself, is taken whole. On the path from there to the body, the text directly in an
element is taken, and a subtree beside it if it is a heading, a block of text (``TEXT``), or at least as dense as the threshold,
the lowest density on the path from the body. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by tag, role, class or id and count as absent throughout.

Text: character references decoded, white space within a block turned into one space, blocks joined by a line break.

Edge cases: null or empty html gives an empty text; broken markup is read as browsers do it, roughly (unclosed elements
end with their parent or a sibling, a cut-off tag is dropped, end tags without a start are ignored); html without any tag
is one text; rows are independent, so repeated rows, null ids and other columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A subtree beside the article with so many links that hold such a share of its characters is a menu, named or not.
MENU_LINKS, MENU_SHARE = 2, 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
NOISE = frozenset("head nav footer aside form button select menu dialog svg canvas object audio video noframes "
                  "script style noscript template textarea title iframe".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id names. The first set always marks noise, the second unless the name also speaks of the article.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie "
                      "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription "
                      "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead toolbar share sharing "
                      "social related recommended recommendations widget pagination pager login signup signin search skip "
                      "copyright disclaimer".split())
ARTICLE = frozenset("article post entry content body main story text".split())
#: Words that may stand beside these in the name of a part inside an article.
LAYOUT = frozenset("area bar block bottom box btn button buttons col column container footer group header holder icon icons inline inner item "
                   "items left link links list mobile outer panel placeholder right row section slot small top unit wrap wrapper".split())
KEPT = frozenset("html body main article".split())
#: Blocks that hold text of the page whatever their density.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl pre table blockquote figure figcaption details".split())
#: Which open elements a start tag ends, besides those inside of them.
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
                  "tfoot thead tr ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("thead", "tbody"), "body": ("head",)}
SCOPE = frozenset("table ul ol dl select div article section body html main".split())

#: Attributes as browsers read them: quotes have a meaning at the start of a value only.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/=]++|[^\s/>=<]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'<][^\s><]*+))?+)*+)>"""
                   r"""|<[!?][^>]*>?|</?[A-Za-z][^<]*\Z""", re.S)
#: One attribute after the other: name and value.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
PART = re.compile(r"[^a-z0-9]+")


def is_noise(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in NOISE or tag == "header" and not inside_article:
        return True
    if not attributes or tag in KEPT:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = {x for x in PART.split(word) if x and not x.isdigit()}
                if parts & COMMENTS or parts & FURNITURE and not parts & ARTICLE:
                    # an article's own section may speak of such things ("related-work"): there the whole name must
                    if not inside_article or parts <= COMMENTS | FURNITURE | LAYOUT:
                        return True
    return False


class Page:
    """The nodes of a page in document order, and its stretches of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise = ["#root"], [-1], [False]
        self.links: list[int] = [0]
        #: (node, block, text, link characters); a block ends at each start or end of an element that is not inline
        self.runs: list[tuple[int, int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        # open elements; where each name is open, and the scopes: no end tag costs more than what it closes
        self.stack: list[tuple[int, str]] = [(0, "#root")]
        self.open: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.link = self.article = 0
        stack, block, at = self.stack, 0, 0
        while at < len(source):
            m = TOKEN.search(source, at)
            text = source[at:m.start()] if m else source[at:]
            if text:
                node = stack[-1][0]
                if not self.noise[node]:
                    text = entities.unescape(text) if "&" in text else text
                    self.runs.append((node, block, text, len("".join(text.split())) if self.link else 0))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                k = self._innermost((tag,), tag in INLINE)
                if k:
                    self._close(k)
                    block += tag not in INLINE
                elif tag == "p":
                    block += 1
                continue
            if tag == "br":
                if not self.noise[stack[-1][0]]:
                    self.runs.append((stack[-1][0], block, " ", 0))
                continue
            if tag in BLOCK:  # ends an open paragraph
                self._close(self._innermost(("p",)))
            if tag in ENDS:
                self._close(self._innermost(ENDS[tag]))
            if tag == "a" and self.link:
                self._close(self._innermost(("a",)))
            node = stack[-1][0]
            if tag in INLINE:
                noise = self.noise[node] or is_noise(tag, m[3], self.article > 0)
                if noise and not self.noise[node]:
                    node = self._add(tag, node, True)
                self.links[node] += tag == "a"
            else:
                block += 1
                noise = self.noise[node] or is_noise(tag, m[3], self.article > 0)
                node = self._add(tag, node, noise)
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK | RAW | INLINE:
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            self.open.setdefault(tag, []).append(len(stack))
            if tag in SCOPE:
                self.scopes.append(len(stack))
            stack.append((node, tag))
            self.link += tag == "a"
            self.article += tag in ("article", "main")

    def _innermost(self, tags: tuple, in_scope: bool = True) -> int:
        """The place of the innermost open element of ``tags`` (0: none); ``in_scope``: unless another scope lies between."""
        k = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        return 0 if in_scope and self.scopes and self.scopes[-1] > k else k

    def _close(self, k: int) -> None:
        """Close the element at place ``k`` and all inside of it."""
        while k and len(self.stack) > k:
            _, t = self.stack.pop()
            self.open[t].pop()
            if t in SCOPE:
                self.scopes.pop()
            self.link -= t == "a"
            self.article -= t in ("article", "main")

    def _add(self, tag: str, parent: int, noise: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.noise.append(noise)
        self.links.append(0)
        return len(self.tag) - 1

    def chosen(self) -> list[bool]:
        """For each node whether its own text belongs to the main text."""
        n = len(self.tag)
        chars, link_chars, tags, links = [0] * n, [0] * n, [0] * n, list(self.links)
        stretches: list[tuple[int, int, int]] = []  # node, characters, link characters
        last = None
        for node, block, text, linked in self.runs:
            size = len("".join(text.split()))
            chars[node] += size
            link_chars[node] += linked
            if last == (node, block):
                stretches[-1] = (node, stretches[-1][1] + size, stretches[-1][2] + linked)
            else:
                stretches.append((node, size, linked))
            last = (node, block)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.noise[i]:
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                links[p] += links[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = link_chars[body] / max(1, chars[body])

        def density(c: int, lc: int, t: int, lt: int) -> float:
            if not c:
                return 0.0
            t += lt
            base = log(c / max(1, c - lc) * lc + share * c + e)
            return c / max(1, t) * log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / max(log(base), 0.1)

        dense = [0.0 if self.noise[i] else density(chars[i], link_chars[i], tags[i], links[i]) for i in range(n)]
        total = [0.0] * n
        for i in range(1, n):
            total[self.parent[i]] += dense[i]
        for node, c, lc in stretches:
            total[node] += density(c, lc, 0, 1 if lc else 0)
        best = max(range(n), key=lambda i: (total[i], -i))
        path = [best]
        while path[-1] not in (body, 0):
            path.append(self.parent[path[-1]])
        threshold = min(dense[i] for i in path)
        self.dense, self.total, self.best, self.threshold = dense, total, best, threshold
        # the article is whole: its references, tables and short sections are no menus
        root = next((i for i in path if self.tag[i] in ("article", "main")), best)
        on_path, take, beside = set(path[path.index(root) + 1:]), [False] * n, [False] * n
        take[root] = True
        beside[root] = self.tag[root] in ("body", "html", "#root")  # the whole page: its menus are beside the text
        for i in range(n):
            if i in on_path:
                take[i] = True
                continue
            p = self.parent[i]
            if i == 0 or i == root or self.noise[i]:
                continue
            if p in on_path:
                menu = links[i] >= MENU_LINKS and link_chars[i] > MENU_SHARE * chars[i]
                take[i] = not menu and (self.tag[i] in TEXT or chars[i] > 0 and dense[i] >= threshold)
                beside[i] = take[i]
            elif take[p]:
                menu = beside[p] and links[i] >= MENU_LINKS and link_chars[i] > MENU_SHARE * chars[i]
                take[i], beside[i] = not menu, beside[p]
        return take

    def text(self) -> str:
        take, blocks = self.chosen(), []
        last = None
        for node, block, text, _ in self.runs:
            if take[node]:
                if block == last:
                    blocks[-1] += text
                else:
                    blocks.append(text)
                last = block
        return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: page_id, url) of ``pages`` and the main text."""
    given = pages.select(*[F.col(f"`{c}`") for c in keep or ["page_id", "url"]], F.col(source).alias("_source"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return given.mapInArrow(run, schema)
