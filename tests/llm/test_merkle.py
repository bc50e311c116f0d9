"""Merkle manifest: every digest, path and verdict against a plain recursive model; edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from litfeed.llm import catalogue
from litfeed.llm import merkle as M
from litfeed.llm.sql import ORACLES
from litfeed.plans.verify import duck

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """nodes -> (top, [path of each node]): a path is a list of (before, after)."""
    paths, at, levels = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(levels) > 1:
        for i in range(len(nodes)):
            a = at[i] - at[i] % 3
            paths[i].append(("".join(levels[a:at[i]]), "".join(levels[at[i] + 1:a + 3])))
            at[i] //= 3
        levels = [sha(*levels[a:a + 3]) for a in range(0, len(levels), 3)]
    return (levels[0] if levels else None), paths


def model(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, sha(*map(told, r))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, out = [], []
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        tops.append(up([leaf for _, leaf in groups[s]]))
    root, crowns = up([t for t, _ in tops])
    for s, (top, paths), crown in zip(order, tops, crowns):
        for (r, leaf), path in zip(groups[s], paths):
            path = path + crown
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = sha(*map(told, (*r[:4], r[4].replace("\n", "") if r[4] is not None and bad else r[4])))
            for a, b in path:
                node = sha(a, node, b)
            out.append((r[0], leaf, top, root, sha(*(x for p in path for x in p)), node, node == root))
    return sorted(out, key=repr)


def query(df):
    return sorted((tuple(r) for r in catalogue.merkle_rows(df).collect()), key=repr)


@pytest.mark.parametrize("span", [1, 2, 7])
def test_documents_against_the_model(spark, monkeypatch, span):
    monkeypatch.setattr(M, "LEVELS", span)
    monkeypatch.setattr(M, "SPAN", 3 ** span)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(70 if span < 7 else 10**6)
    rows = [tuple(r) for r in docs.select(*M.FIELDS).collect()]
    got = query(spark.createDataFrame(rows, SCHEMA))
    assert got == model(rows)
    assert {g[6] for g in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_counts_around_powers_of_three(spark, monkeypatch, n):
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "SPAN", 3)
    rows = [(i, "a", "x", i, f"t{i}\nu") for i in range(n)]
    assert query(spark.createDataFrame(rows, SCHEMA)) == model(rows)


def test_edge_cases(spark):
    rows = [(1, None, None, None, None), (None, "b", "x", 3, "a\nb"), (2, "b", "", 0, ""), (2, "b", "", 0, ""), (5, "", "é", 1, "\n\n"),
            (-7, "é", "x", 2, "🙂\n" * 5), (3, "z", None, 9, "long\n" * 100_000)] + [(10, "c", "l", 1, "same\ntext")] * 5
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA + ", pos int, `_row` string")
    assert query(df) == model(rows)
    assert query(df.limit(0)) == []
    lone = query(df.filter("doc_id = 3"))
    assert lone[0][1] == lone[0][2] == lone[0][3] and lone[0][4] == hashlib.sha256(b"").hexdigest()


def test_many_groups_have_a_tree_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "SPAN", 9)
    rows = [(i, f"s{i % 40}", "x", i, f"t{i}") for i in range(100)]
    assert query(spark.createDataFrame(rows, SCHEMA)) == model(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_twin_states_the_model(sf):
    con = duck(f"/root/testdata/{sf}")
    rows = con.sql(f"SELECT {', '.join(M.FIELDS)} FROM documents").fetchall()
    want = con.sql(ORACLES["op11_merkle_manifest"])
    assert want.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(want.fetchall(), key=repr) == model(rows)


def test_any_change_of_any_field_is_found(spark):
    rows = [(i, "a", "x", i, f"t{i}") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    for field, value in (("lang", F.lit("y")), ("n_chars", F.lit(99)), ("text", F.lit(None).cast("string")), ("source", F.lit("b"))):
        got = M.checked(df, {field: value}, F.col("doc_id") == 4).collect()
        assert sorted(r["id"] for r in got if not r["verified"]) == [4]


def test_a_window_is_a_block_not_a_group(spark):
    df = spark.createDataFrame([(i, "a", "x", i, "t") for i in range(10)], SCHEMA)
    plan = M.manifest(df)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window " in x and "lag" in x]
    assert windows and all("block#" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in windows)
