"""Line-first quality rules: SQL twin, line rules, edge cases."""

import pytest

from litfeed.llm import quality
from litfeed.llm.sql import ORACLES
from litfeed.plans.verify import duck, rows_of

SF = "/root/testdata/sf0.001"
PROSE = "\n".join(f"This plain sentence{i} says number{i}, with{i} a few more words{i} in it." for i in range(8))


def rows(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def test_sql_twin(spark):
    got = quality.report(spark.read.parquet(f"{SF}/documents.parquet"))
    want = duck(SF).sql(ORACLES["op6_quality_rules"])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_sql_twin_states_the_rule_for_wrapped_text(spark, tmp_path):
    """Wrapped prose, blank lines of any width, closing marks, capitals after long and short lines."""
    import random
    import textwrap

    import duckdb
    rnd, ends = random.Random(3), ['.', '."', ".')", "…", "", "", "", "", " ", "!  ", "۔", ":"]
    texts = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randint(1, 8)):
            words = " ".join(rnd.choice(("word", "Haus", "über", "It", "42")) + str(rnd.randint(0, 999)) for _ in range(rnd.randint(1, 60)))
            lines += textwrap.wrap(words, rnd.choice((30, 72, 80, 131, 134, 400))) if rnd.random() < 0.7 else [words]
            lines[-1] += rnd.choice(ends)
            lines += rnd.choice(([], [], [""], [" " * 40], [" " * 90], ["\t"]))
        texts.append("\n".join(lines))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality.report(df)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(ORACLES["op6_quality_rules"])
    rows_ = [tuple(r) for r in got.collect()]
    assert rows_of(got.columns, rows_) == rows_of(want.columns, want.fetchall())
    assert len({r[got.columns.index("n_bad_lines")] for r in rows_}) > 3


def test_the_measures_are_computed_once(spark):
    plan = quality.cleaned(rows(spark, [PROSE]))._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if x.strip(" :+-").startswith("Filter")]
    assert filters and all("xxhash64" not in x and "rlike" not in x.lower() for x in filters)


def test_repeated_words_against_brute_force(spark):
    import random
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += [" ".join("abcdefgh"), " ".join("abcdefgh" * 2), "x " * 50]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.report(rows(spark, texts)).collect()}
    assert got == {i: brute_repeats(t.split()) for i, t in enumerate(texts)}


def test_edge_cases(spark):
    texts = [None, "", " \t\n\x0b\f\r", "é" * 5, "a#b *$", "x\nx\n \nx", PROSE, PROSE]
    got = {r["doc_id"]: r for r in quality.report(rows(spark, texts)).collect()}
    assert [got[i]["n_words"] for i in range(6)] == [0, 0, 0, 1, 2, 3]
    assert got[3]["word_chars"] == 5 and got[4]["n_symbols"] == 3 and got[5]["n_dup_lines"] == 2
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in range(6))
    assert got[6]["kept"] and got[7]["kept"] and got[6]["n_bad_lines"] == 0
    assert quality.report(rows(spark, [])).count() == 0


@pytest.mark.parametrize("line", [
    "Home | News | Sports | Contact | About", "We use cookies to make this site better.", "BUY!! NOW!! BEST!! PRICE!!",
    "###%% &&& ***$$$ word### other%%%", "one two three four five six seven eight nine ten eleven twelve thirteen"])
def test_failing_lines_go(spark, line):
    df = rows(spark, [PROSE + "\n" + line]).selectExpr("doc_id", "text", "length(text) n_chars")
    out = quality.cleaned(df).collect()
    assert len(out) == 1 and out[0]["text"] == PROSE and out[0]["n_chars"] == len(PROSE)


@pytest.mark.parametrize("width", [60, 72, 80, 100, 120])
def test_wrapped_prose_is_kept_unchanged(spark, width):
    import textwrap
    words = "the river runs from the old mill over flat land to Bergen and Oslo where it meets another one".split()
    sentence = lambda k, n: " ".join([f"On day {k}", *(words[(k * 7 + j) % len(words)] + str(k * n + j) for j in range(n))]) + "."
    capitals = lambda k: " ".join(["Da", *(f"Haus{k}x{j} Wald{j}" for j in range(25))]) + "."
    paragraphs = [" ".join(sentence(k, 40 + k) for k in range(i, i + 3)) + " " + capitals(i) for i in range(0, 12, 3)]
    text = "\n\n".join(textwrap.fill(p, width) for p in paragraphs)
    crlf = text.replace("\n", "\r\n")
    docs = rows(spark, [text, crlf])
    assert {r["doc_id"]: r["text"] for r in quality.cleaned(docs).collect()} == {0: text, 1: crlf}


@pytest.mark.parametrize("mark", list("\u06d4\u0589\u1362\u061f\u17d4\u104b\u0f0d\u1803\uff61\u0964\u3002"))
def test_other_scripts_sentences_are_kept(spark, mark):
    text = "\n".join(" ".join(f"\u0627\u0628{i}\u062c{j}" for j in range(20)) + mark for i in range(5))
    assert [r["text"] for r in quality.cleaned(rows(spark, [text])).collect()] == [text]


@pytest.mark.parametrize("line", [" ".join(f"w{j}" for j in range(14)), " ".join(f"word{j}" for j in range(60))])
def test_lines_that_no_sentence_goes_on_in_still_fail(spark, line):
    df = rows(spark, [PROSE + "\n" + line + "\n\n" + PROSE.replace("plain", "other"), PROSE + "\n" + line + "\n" + line.replace("w", "v")])
    assert [r["n_bad_lines"] for r in quality.report(df).orderBy("doc_id").collect()] == [1, 2]


def test_document_that_loses_too_much_is_rejected(spark):
    junk = "\n".join(f"Home{i} | News{i} | Sports{i} | Contact{i} | About{i} | More{i}" for i in range(20))
    assert quality.cleaned(rows(spark, [PROSE + "\n" + junk])).count() == 0


def test_clean_documents_keep_rows_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, PROSE, 7, "a"), (1, PROSE, 7, "a"), (None, PROSE, None, None)],
                               "doc_id long, text string, quality int, q_words string")
    out = quality.cleaned(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_long_text(spark):
    got = quality.report(rows(spark, ["\n".join([PROSE for i in range(3000)])])).first()
    assert got["n_words"] == 3000 * len(PROSE.split()) and got["n_repeat_words"] > 0
