"""Keyword boundaries and context gates (C-10, D-7, D-8): every strategy against a plain search, on texts made by rule."""

import random
import re

import pytest

from litfeed.operators import classify as C

METHODS = ["literal", "broadcast", "tokens"]
KEYWORDS = {"laser": ("laser",), "spin": ("spin wave", "magnon"), "lang": ("F#",), "dotted": ("v.2",), "greek": ("ωμέγα",)}
GROUP = {"laser": "optics", "spin": "magnetism", "lang": "software", "dotted": "software", "greek": "letters"}
NEEDS = {"dotted": ("optics", "letters"), "lang": ("magnetism",)}


def run(spark, texts, method, exact=False, keywords=KEYWORDS, needs=NEEDS):
    arts = spark.createDataFrame([(f"a{i}", a, b) for i, (a, b) in enumerate(texts)], "uid string, title string, abstract string")
    rules = spark.createDataFrame([(t, t, GROUP[t], t in needs, k) for t, ks in keywords.items() for k in ks],
                                  "topic_id string, label string, group_id string, gated boolean, keyword string")
    topics = spark.createDataFrame([(t, t, GROUP[t], t in needs) for t in keywords],
                                   "topic_id string, label string, group_id string, gated boolean")
    gates = spark.createDataFrame([(t, g) for t, gs in needs.items() for g in gs] or [("-", "-")], "topic_id string, required_group string")
    found = {f"a{i}": set() for i in range(len(texts))}
    for r in C.classify(arts, rules, topics, gates, method=method, exact=exact).collect():
        assert r.tag_id not in found[r.article_uid]
        found[r.article_uid].add(r.tag_id)
    return [found[f"a{i}"] for i in range(len(texts))]


def plain(text, keyword):
    """Whether a keyword stands in a text, with no token character or character of its own marks beside it."""
    if text is None:
        return False
    fold = lambda s: " ".join(re.sub(r"[-‐-―\s]+", " ", s.casefold()).split())
    t, k = fold(text), fold(keyword)
    marks = set(re.sub(r"[\w\s]", "", k))
    beside = lambda c: bool(c) and (c.isalnum() or c == "_" or c in marks)
    return any(not beside(t[max(0, m.start() - 1):m.start()]) and not beside(t[m.start() + len(k):m.start() + len(k) + 1])
               for m in re.finditer(f"(?={re.escape(k)})", t))


def expected(texts):
    out = []
    for fields in texts:
        hits = {t for t, ks in KEYWORDS.items() if any(plain(f, k) for f in fields for k in ks)}
        opened = {GROUP[t] for t in hits if t not in NEEDS}
        out.append({t for t in hits if t not in NEEDS or opened & set(NEEDS[t])})
    return out


def made(seed, n):
    rnd = random.Random(seed)
    words = ["laser", "LASER", "lasers", "laser2", "spin", "wave", "Magnon", "magnons", "F#", "f##", "F", "v.2", "v.2.1", "v2", "ωμέγα", "ΩΜΈΓΑ", "x", "_"]
    joins = [" ", "  ", "-", "–", "\n", ", ", ". ", "/", "_", ""]
    text = lambda: "".join(rnd.choice(words) + rnd.choice(joins) for _ in range(rnd.randint(0, 7)))
    return [(rnd.choice([text(), None]), rnd.choice([text(), None])) for _ in range(n)]


@pytest.mark.parametrize("method", METHODS)
def test_against_a_plain_search(spark, method):
    texts = made(1, 250)
    want = expected(texts)
    assert run(spark, texts, method) == want and len(set().union(*want)) == len(KEYWORDS)


@pytest.mark.parametrize("method", METHODS)
def test_a_combining_mark_belongs_to_its_letter(spark, method):
    marked = [("laser̄ beam", None), ("लेसर laser", None)]
    assert run(spark, marked, method) == [set(), {"laser"}]


def test_markup_and_references_before_the_search(spark):
    texts = [("<b>la</b>ser", None), ("spin&#45;wave", None), ("<script>laser</script>", None), (None, "&Omega;&Mu;&#904;&Gamma;&Alpha;")]
    assert run(spark, texts, "literal") == [{"laser"}, {"spin"}, set(), {"greek"}]


def test_exact_path_composes_texts_and_keywords(spark):
    keys = {"laser": ("Å-laser",)}
    assert run(spark, [("an Å-laser", None)], "literal", exact=True, keywords=keys, needs={}) == [{"laser"}]


@pytest.mark.parametrize("method", METHODS)
def test_gated_topics_do_not_open_each_other(spark, method):
    needs = {"laser": ("magnetism",), "spin": ("optics",)}
    keys = {k: KEYWORDS[k] for k in ("laser", "spin", "greek")}
    assert run(spark, [("laser and magnon", None), ("ωμέγα laser", None)], method, keywords=keys, needs=needs) == [set(), {"greek"}]


def test_rare_tokens_are_the_anchors_of_a_large_catalogue(spark):
    """20,000 rules that all begin with words of every text: candidates follow the hits, and hits equal a plain search."""
    rnd = random.Random(11)
    texts = [" of the ".join(f"w{rnd.randrange(40_000)}" for _ in range(12)) + " of the" for _ in range(200)]
    arts = spark.createDataFrame([(f"a{i}", t, None) for i, t in enumerate(texts)], "uid string, title string, abstract string")
    rules = spark.createDataFrame([(f"t{i}", f"of the w{i}") for i in range(20_000)], "topic_id string, keyword string")
    want = {(f"a{i}", f"t{w}") for i, t in enumerate(texts) for w in map(int, re.findall(r"(?<=of the w)\d+", t)) if w < 20_000}
    fields = C.match_fields(arts)
    assert {tuple(r) for r in C.keyword_hits(fields, rules, "tokens").collect()} == want
    compiled = C.compile_rules(rules)
    tokens = fields.where("text IS NOT NULL").selectExpr("uid", "field", "explode(array_distinct(split(text, ' '))) AS token")
    anchored = C.rarest_anchors(compiled, tokens).select("topic_id", "anchor").checkpoint()
    assert anchored.count() == 20_000 and anchored.where("anchor IN ('of', 'the')").count() == 0
    candidates = tokens.join(anchored, tokens.token == anchored.anchor).count()
    by_first = tokens.join(compiled.select("anchor"), tokens.token == compiled.anchor).count()
    assert len(want) <= candidates <= 2 * len(want) and by_first == 20_000 * 200
