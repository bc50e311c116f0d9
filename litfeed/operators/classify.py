"""Keyword classifier (C-10, D-7, D-8, E-7, E-14).

Semantics: a keyword hits a field when it occurs in the match-normalised text
and neither neighbour is a token character (letter, number, mark, connector
punctuation) nor any punctuation character that the keyword itself contains.
Title and abstract are tested separately. A gated topic survives only if one of
its required groups has an *ungated* hit on the same article (one pass).

Three physical strategies give the same rows:

* ``literal`` (catalogues up to 512 rules, checked): the compiled rules are
  embedded in the plan, so every regex is compiled once per task and the
  test is a narrow projection: no join, no shuffle of the corpus.

* ``broadcast``: the rule catalogue (bounded, checked) is broadcast and each
  field row is tested against each rule (`contains` prefilter, then the
  boundary regex). No shuffle of the corpus at all.
* ``tokens``: every field is cut into distinct tokens, joined on the rule's
  anchor token (equi-join, works for catalogues of any size), and only the
  candidate (field, rule) pairs are re-checked with the boundary regex. The
  anchor is the keyword's rarest token in the corpus, so "of the laser" is
  tried where "laser" stands, not in every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litfeed.functions.text import TOKEN_CLASS, clean_text, visible_text, match_normalize, match_normalize_exact
from litfeed.operators.util import bounded_broadcast, ensure_parallel, single_row
from litfeed.session import checkpoint_dir

# Up to this many rules the catalogue is embedded in the plan as literals.
MAX_LITERAL_RULES = 512


def match_fields(articles: DataFrame, exact: bool = False) -> DataFrame:
    """(uid, field, text): cleaned, match-normalised title and abstract, NULLs dropped."""
    clean = clean_text if exact else visible_text
    norm = match_normalize_exact if exact else match_normalize
    stacked = ensure_parallel(articles.select("uid", "title", "abstract"), "uid").select(
        "uid",
        F.explode(F.array(
            F.struct(F.lit("title").alias("field"), F.col("title").alias("raw")),
            F.struct(F.lit("abstract").alias("field"), F.col("abstract").alias("raw")),
        )).alias("f"),
    ).select("uid", "f.field", "f.raw")
    # NULL texts simply never match; no filter here, so the cleaning chain is
    # evaluated once per field (a filter would be pushed below and recompute it)
    return stacked.select("uid", "field", norm(clean(F.col("raw"))).alias("text"))


def _escape(col):
    return F.regexp_replace(col, rf"([^{TOKEN_CLASS} ])", r"\\$1")


def compile_rules(rules: DataFrame, exact: bool = False) -> DataFrame:
    """Adds ``kw`` (normalised keyword), ``pattern`` (boundary regex) and ``anchor``
    (first token of the keyword, NULL when it has none)."""
    clean, norm = (clean_text, match_normalize_exact) if exact else (visible_text, match_normalize)
    kw = norm(clean(F.col("keyword")))  # keywords take the path of the texts
    out = rules.withColumn("kw", kw).where(F.col("kw").isNotNull() & (F.col("kw") != ""))
    punct = F.regexp_replace(F.col("kw"), rf"[\s{TOKEN_CLASS}\p{{Pd}}]", "")
    fence = F.concat(F.lit("[" + TOKEN_CLASS), _escape(punct), F.lit("]"))
    # the keyword first: it is searched as a literal, and what stands beside it is looked at only where it occurs
    word = _escape(F.col("kw"))
    pattern = F.concat(word, F.lit("(?<!"), fence, word, F.lit(")(?!"), fence, F.lit(")"))
    anchor = F.regexp_extract(F.col("kw"), f"[{TOKEN_CLASS}]+", 0)
    return out.withColumn("pattern", pattern).withColumn("anchor", F.when(anchor != "", anchor))


def rarest_anchors(compiled: DataFrame, tokens: DataFrame) -> DataFrame:
    """``compiled`` with the anchor that the fewest of ``tokens`` (uid, field, token: those of the corpus that stand in a keyword) name;
    ties: the smallest. A hit has no token character beside the keyword, so each token of the keyword is a token of the text."""
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    of_rule = compiled.select("kw", F.explode(F.array_distinct(F.regexp_extract_all("kw", F.lit(f"[{TOKEN_CLASS}]+"), 0))).alias("token")).distinct()
    best = of_rule.join(seen, "token", "left").groupBy("kw").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("anchor"))
    return compiled.drop("anchor").join(best, "kw")


def keyword_hits(fields: DataFrame, rules: DataFrame, method: str = "tokens", exact: bool = False) -> DataFrame:
    """Distinct (uid, topic_id) pairs whose keyword hits title or abstract."""
    compiled = compile_rules(rules, exact).select("topic_id", "kw", "pattern", "anchor")
    if method == "literal":
        raise ValueError("the literal strategy works on articles, not on fields: use classify")
    if method == "broadcast":
        cond = F.expr("contains(text, kw) AND text RLIKE pattern")
        pairs = fields.join(F.broadcast(compiled), cond, "inner")
    elif method == "tokens":
        checkpoint_dir(fields.sparkSession)
        tokened = compiled.where(F.col("anchor").isNotNull())
        of_rules = tokened.select(F.explode(F.regexp_extract_all("kw", F.lit(f"[{TOKEN_CLASS}]+"), 0)).alias("token")).distinct()
        toks = fields.select(
            "uid", "field",
            F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{TOKEN_CLASS}]+"), 0))).alias("token"))
        # narrow rows, read twice: to count the tokens and to find the candidates
        toks = toks.join(bounded_broadcast(of_rules), "token", "left_semi").checkpoint(eager=True)
        anchored = bounded_broadcast(rarest_anchors(tokened, toks))
        cands = toks.join(anchored, toks.token == anchored.anchor).select("uid", "field", "topic_id", "kw", "pattern")
        # one row per (uid, field) with its candidate rules, so the text is joined once, not once per candidate
        per_field = cands.groupBy("uid", "field").agg(
            F.collect_set(F.struct("topic_id", "kw", "pattern")).alias("cands"))
        checked = per_field.join(fields, ["uid", "field"]).select(
            "uid", F.explode(F.filter("cands", lambda c: F.contains(F.col("text"), c["kw"])
                                      & F.rlike(F.col("text"), c["pattern"]))).alias("c"))
        pairs = checked.select("uid", F.col("c.topic_id").alias("topic_id"))
        # keywords without any token character cannot be anchored: test them directly
        loose = compiled.where(F.col("anchor").isNull()).select("topic_id", "kw", "pattern")
        loose_pairs = fields.join(bounded_broadcast(loose), F.expr("contains(text, kw) AND text RLIKE pattern"))
        pairs = pairs.unionByName(loose_pairs.select("uid", "topic_id"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return pairs.select("uid", "topic_id").distinct()


def apply_gates(hits: DataFrame, topics: DataFrame, gates: DataFrame) -> DataFrame:
    """D-8: keep ungated hits; keep a gated hit when a required group has an ungated hit.

    One pass: the (bounded) topic catalogue with its required groups is
    broadcast, and the groups opened on each article come from a window over
    that article's own hits (at most one row per topic), so the hit set is
    computed once and no article's rows can grow unbounded.
    """
    req = gates.groupBy("topic_id").agg(F.collect_set("required_group").alias("required"))
    t = bounded_broadcast(topics.select("topic_id", "group_id", "gated").join(req, "topic_id", "left"))
    h = hits.join(t, "topic_id")
    opened = F.collect_set(F.when(~F.col("gated"), F.col("group_id"))).over(Window.partitionBy("uid"))
    h = h.withColumn("opened", opened)
    keep = ~F.col("gated") | F.exists(F.coalesce("required", F.array().cast("array<string>")),
                                      lambda g: F.array_contains(F.col("opened"), g))
    return h.where(keep).select("uid", "topic_id")


def _in_row(articles: DataFrame, rules: list, topics: list, required: dict, exact: bool) -> DataFrame:
    """Hits and gates of each article on its own row (no shuffle): rules, topics and gates are literals."""
    clean, norm = (clean_text, match_normalize_exact) if exact else (visible_text, match_normalize)
    d = ensure_parallel(articles.select("uid", "title", "abstract"), "uid")
    d = d.select("uid", norm(clean(F.col("title"))).alias("title"), norm(clean(F.col("abstract"))).alias("abstract"))
    hit = lambda text, r: F.coalesce(text.contains(r.kw) & text.rlike(r.pattern), F.lit(False))
    d = d.select("uid", F.array_distinct(F.array_compact(F.array(*[
        F.when(hit(F.col("title"), r) | hit(F.col("abstract"), r), F.lit(r.topic_id)) for r in rules]))).alias("hits"))
    found = lambda t: F.array_contains("hits", t.topic_id)
    none = F.array().cast("array<string>")
    opened = F.array_compact(F.array(*[F.when(found(t), F.lit(t.group_id)) for t in topics if not t.gated] or [F.lit(None).cast("string")]))
    d = d.withColumn("opened", opened)
    kept = [F.when(found(t) & (F.lit(not t.gated) | F.arrays_overlap("opened", F.array(*map(F.lit, required.get(t.topic_id, ())))
                                                                     if required.get(t.topic_id) else none)), F.lit(t.topic_id))
            for t in topics]
    return d.select(F.col("uid").alias("article_uid"), F.explode(F.array_distinct(F.array_compact(F.array(*kept)))).alias("tag_id"))


def classify(articles: DataFrame, rules: DataFrame, topics: DataFrame, gates: DataFrame,
             method: str = "auto", exact: bool = False) -> DataFrame:
    """Full-corpus retag: returns the article_tags bridge (article_uid, tag_id).

    ``literal`` keeps the catalogue in the plan and needs one row per uid; ``auto`` takes it for catalogues of up to
    ``MAX_LITERAL_RULES`` rules and the token join beyond. All strategies give the same rows.
    """
    if method in ("auto", "literal"):
        compiled = compile_rules(rules, exact).select("topic_id", "kw", "pattern").limit(MAX_LITERAL_RULES + 1).collect()
        if len(compiled) <= MAX_LITERAL_RULES:
            names = sorted({r.topic_id for r in compiled})
            known = [t for t in topics.where(F.col("topic_id").isin(names)).select("topic_id", "group_id", "gated").distinct().collect()] if names else []
            required: dict = {}
            for g in gates.where(F.col("topic_id").isin(names)).select("topic_id", "required_group").distinct().collect() if names else ():
                required.setdefault(g.topic_id, []).append(g.required_group)
            if not known:
                return articles.select(F.col("uid").alias("article_uid"), F.lit(None).cast("string").alias("tag_id")).where("false")
            return _in_row(articles, compiled, known, required, exact)
        if method == "literal":
            raise ValueError("rule catalogue too large for the literal strategy")
        method = "tokens"
    hits = keyword_hits(match_fields(articles, exact), rules, method, exact)
    return apply_gates(hits, topics, gates).select(F.col("uid").alias("article_uid"), F.col("topic_id").alias("tag_id"))


def classification_summary(articles: DataFrame, article_tags: DataFrame) -> DataFrame:
    """E-7: scanned, tagged, assignments, active tags (one row)."""
    return single_row(
        articles.agg(F.count(F.lit(1)).alias("articles_scanned")),
        article_tags.agg(
            F.count_distinct("article_uid").alias("articles_tagged"),
            F.count(F.lit(1)).alias("tag_assignments"),
            F.count_distinct("tag_id").alias("active_tags"),
        ),
    )


def label_conflicts(topics: DataFrame) -> DataFrame:
    """E-14: one id with two labels, or one label under two ids."""
    by_id = topics.groupBy(F.col("topic_id").alias("key")).agg(F.count_distinct("label").alias("n")) \
        .where("n > 1").withColumn("kind", F.lit("id_with_labels"))
    by_label = topics.groupBy(F.col("label").alias("key")).agg(F.count_distinct("topic_id").alias("n")) \
        .where("n > 1").withColumn("kind", F.lit("label_with_ids"))
    return by_id.unionByName(by_label)
