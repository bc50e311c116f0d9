"""The aggregate merge equals applying items one by one (D-1, E-10, B-18).

The sequential model below is written for this test from the documented
upsert rules: identity by DOI, then URL alias, then candidate UID; the first
matching row survives and absorbs the others; per field an incoming known
value replaces the current one unless the current one is enriched and the
incoming one is not; an absorbed row's value replaces the survivor's only if
the survivor's is unknown, or the absorbed one is enriched and the survivor's
is not.
"""

import hashlib
import random


from litfeed.operators import identity as I
from litfeed.operators import merge as M

RANK = {"rss_only": 0, "partial": 1, "enriched": 2}
PLACEHOLDER = "N/A"


def h(u):
    return hashlib.sha256(u.encode()).hexdigest()[:24]


def known(f, v):
    if f == "title":
        return v is not None and v != PLACEHOLDER
    return v in ("open", "closed")


def fold(items):
    return _fold_from({}, {}, items)


def history(rng, hid):
    n_url = rng.randint(1, 4)
    dois = [f"10.9/{hid}-{d}" for d in range(rng.randint(1, 2))]
    url_doi = {f"https://h{hid}/{u}": (rng.choice(dois) if rng.random() < 0.7 else None) for u in range(n_url)}
    journal = {d: f"j{hid}-{i}" for i, d in enumerate(dois)}
    items = []
    for s in range(rng.randint(1, 8)):
        url = rng.choice(list(url_doi))
        d = url_doi[url] if rng.random() < 0.6 else None
        items.append(dict(seq=hid * 100 + s, url=url, doi=d,
                          journal=journal[url_doi[url]] if url_doi[url] else f"j{hid}-u",
                          title=rng.choice([PLACEHOLDER, "A", "B", "C"]), oa_status=rng.choice(["unknown", "open", "closed"]),
                          enr=bool(d) and rng.random() < 0.4, status=rng.choice(list(RANK))))
    return items


def test_merge_equals_sequential_fold(spark):
    rng = random.Random(7)
    hists = [history(rng, k) for k in range(400)]
    rows = [(i["seq"], i["url"], i["doi"], i["journal"], i["title"], None, None, "other", i["oa_status"], i["status"], i["enr"])
            for hs in hists for i in hs]
    df = spark.createDataFrame(rows, "seq long, url string, doi string, journal_id string, title string, abstract string, "
                                     "published_at timestamp, article_type string, oa_status string, metadata_status string, enriched boolean")
    merged = M.merge(I.resolve(df), fields=("title", "oa_status")).select(
        "uid", "doi", "journal_id", "normalized_url", "title", "title_enriched", "oa_status", "oa_status_enriched",
        "metadata_status")
    got = {r.uid: r for r in merged.collect()}
    expected = {}
    for hs in hists:
        expected.update(fold(hs))
    assert set(got) == set(expected)
    for uid, a in expected.items():
        r = got[uid]
        assert (r.doi, r.journal_id, r.normalized_url, r.metadata_status) == (a["doi"], a["journal"], a["url"], a["status"]), uid
        assert (r.title, r.title_enriched) == tuple(a["fields"]["title"]), uid
        assert (r.oa_status, r.oa_status_enriched) == tuple(a["fields"]["oa_status"]), uid


def fold_outcomes(items):
    """Outcome per item from the same sequential model."""
    arts, aliases, out = {}, {}, {}
    for it in items:
        before = {u: (a["doi"], a["url"], a["journal"], a["status"], tuple(map(tuple, a["fields"].values())))
                  for u, a in arts.items()}
        cand = f"doi:{it['doi']}" if it["doi"] else f"url:{h(it['url'])}"
        doi_row = next((u for u, a in arts.items() if it["doi"] and a["doi"] == it["doi"]), None)
        url_row = aliases.get(it["url"]) or next((u for u, a in arts.items() if a["url"] == it["url"]), None)
        uid_row = cand if cand in arts else None
        ordered = [r for i, r in enumerate((doi_row, url_row, uid_row)) if r is not None and r not in (doi_row, url_row, uid_row)[:i]]
        fold_one(arts, aliases, it)
        if not ordered:
            out[it["seq"]] = "inserted"
        elif len(ordered) > 1:
            out[it["seq"]] = "updated"
        else:
            a = arts[ordered[0]]
            now = (a["doi"], a["url"], a["journal"], a["status"], tuple(map(tuple, a["fields"].values())))
            out[it["seq"]] = "skipped" if now == before[ordered[0]] else "updated"
    return out


def fold_one(arts, aliases, it):
    """Apply one item (same rules as ``fold``), in place."""
    tmp = fold_state(arts, aliases, [it])
    arts.clear()
    arts.update(tmp)


def fold_state(arts, aliases, items):
    import copy
    return _fold_from(copy.deepcopy(arts), aliases, items)


def _fold_from(arts, aliases, items):
    for it in items:
        cand = f"doi:{it['doi']}" if it["doi"] else f"url:{h(it['url'])}"
        doi_row = next((u for u, a in arts.items() if it["doi"] and a["doi"] == it["doi"]), None)
        url_row = aliases.get(it["url"]) or next((u for u, a in arts.items() if a["url"] == it["url"]), None)
        uid_row = cand if cand in arts else None
        ordered = []
        for r in (doi_row, url_row, uid_row):
            if r is not None and r not in ordered:
                ordered.append(r)
        inc = {f: (it[f], it["enr"] and known(f, it[f])) for f in ("title", "oa_status")}
        if not ordered:
            arts[cand] = dict(doi=it["doi"], url=it["url"], journal=it["journal"], status=it["status"],
                              fields={f: [v, e] for f, (v, e) in inc.items()})
            aliases[it["url"]] = cand
            continue
        surv, losers = ordered[0], ordered[1:]
        for u, tgt in list(aliases.items()):
            if tgt in losers:
                aliases[u] = surv
        for r in ordered:
            aliases[arts[r]["url"]] = surv
        aliases[it["url"]] = surv
        m = arts[surv]
        for lu in losers:
            lo = arts.pop(lu)
            if m["doi"] is None and lo["doi"] is not None:
                m["doi"] = lo["doi"]
            for f in ("title", "oa_status"):
                cv, ce = m["fields"][f]
                lv, le = lo["fields"][f]
                if known(f, lv) and (not known(f, cv) or (le and not ce)):
                    m["fields"][f][0] = lv
                m["fields"][f][1] = ce or le
            m["status"] = max(m["status"], lo["status"], key=RANK.get)
        for f, (v, e) in inc.items():
            cv, ce = m["fields"][f]
            if known(f, v) and (not known(f, cv) or e or not ce):
                m["fields"][f] = [v, e]
        m["doi"] = it["doi"] or m["doi"]
        m["journal"], m["url"] = it["journal"], it["url"]
        m["status"] = max(m["status"], it["status"], key=RANK.get)
    return arts


def test_outcomes_equal_sequential_fold(spark):
    from litfeed.operators.outcomes import outcomes
    rng = random.Random(11)
    hists = [history(rng, k) for k in range(300)]
    rows = [(i["seq"], i["url"], i["doi"], i["journal"], i["title"], None, None, "other", i["oa_status"], i["status"], i["enr"])
            for hs in hists for i in hs]
    df = spark.createDataFrame(rows, "seq long, url string, doi string, journal_id string, title string, abstract string, "
                                     "published_at timestamp, article_type string, oa_status string, metadata_status string, enriched boolean")
    got = {r.seq: r.outcome for r in outcomes(I.resolve(df), fields=("title", "oa_status"), chunk=3).collect()}
    expected = {}
    for hs in hists:
        expected.update(fold_outcomes(hs))
    bad = [(s, got.get(s), e) for s, e in expected.items() if got.get(s) != e]
    assert not bad, bad[:10]
