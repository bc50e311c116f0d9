"""The pipeline against brute-force stages, and the registered queries."""

import os

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from litfeed.llm import packing
from litfeed.llm.catalogue import QUERIES, SQL
from litfeed.plans.verify import duck, rows_of

from test_decontam import brute as leaks
from test_packing import check
from test_quality import brute_repeats
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def staged(spark, docs, upto):
    for _, stage in P.STAGES[:upto]:
        docs = stage(spark, docs, SF).cache()
        yield docs


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept, one, clean = staged(spark, docs, 3)
    assert all(d.columns == docs.columns for d in (kept, one, clean))
    full, kept, one, clean = map(rows, (docs, kept, one, clean))
    for d, t in full.items():
        words = t.split()
        if len(words) < 20 or 100 * brute_repeats(words) > 30 * len(words):
            assert d not in kept
        elif d in kept:  # only whole lines go
            lines = iter(t.split("\n"))
            assert all(x in lines for x in kept[d].split("\n"))
    ids = sorted(kept)
    roots = brute_components([brute_fingerprint(kept[d]) for d in ids])
    assert sorted(one) == sorted({ids[r] for r in roots}) and all(one[d] == kept[d] for d in one)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in leaks(sorted(one.items()), items)}
    assert bad and sorted(clean) == sorted(set(one) - bad)
    import public_tokenizers
    df = spark.createDataFrame(sorted(clean.items()), "doc_id long, text string")
    assert check(packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect(), sorted(clean.items())) > 0.95
    got = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(clean)


def test_stages_take_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", None, "s", 0, 2), (1, "", None, "s", 0, 2)],
                                "doc_id long, text string, lang string, source string, n_chars long, best int")
    for df in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= df.count() and (name == "packing" or out.columns == df.columns)


def test_every_operator_has_one_query():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 11))
    assert "pipeline" in E.queries() and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    got, want = QUERIES[name](spark, SF), duck(SF).sql(SQL[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_library_does_not_import_this_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(top, "litfeed")):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as h:
                        assert "litfeed.llm" not in h.read(), f
