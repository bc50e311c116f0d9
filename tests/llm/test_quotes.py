"""Quotation linking against a plain sequential model, reply order, edge cases."""

import random
import re

from litfeed.llm import quotes as Q

SF = "/root/testdata/sf0.001"


def norm(s):
    return " ".join(re.findall(r"[^\W_]+", s.lower()))


def plain(messages):
    """messages: (conv, turn, text) -> {(conv, turn): (parent, linked)}"""
    says, out = {}, {}
    for conv, turn, text in sorted(messages):
        lines = [(len(re.match(r"[ \t]*((?:>[ \t]?)*)", x)[1].replace(" ", "")), re.sub(r"^[ \t]*(?:>[ \t]?)+", "", x)) for x in text.split("\n")]

        def units(level):
            t = "\n".join(x if lv == level else "" for lv, x in lines)
            return {norm(u) for u in t.split("\n") + re.split(r"\n[ \t]*\n", t)} - {""}

        votes, linked = {}, 0
        for level in sorted({lv for lv, _ in lines if lv > 0}):
            for u in units(level):
                at = max((s for s in says.get((conv, u), ()) if s < turn), default=None)
                if at is not None:
                    votes[level, at] = votes.get((level, at), 0) + 1
                    linked += 1
        parent = max(((-lv, n, t) for (lv, t), n in votes.items()), default=(0, 0, None))[2]
        out[conv, turn] = (parent, linked)
        for u in units(0):
            says.setdefault((conv, u), set()).add(turn)
    return out


def thread(out, key):
    while out[key][0] is not None:
        key = (key[0], out[key][0])
    return key[1]


def made(seed, n=200, convs=3):
    rnd, said, out = random.Random(seed), {}, []
    for i in range(n):
        conv = rnd.randrange(convs)
        old = said.setdefault(conv, [])
        text = []
        for _ in range(rnd.randint(0, 2)):
            if old:
                q = rnd.choice(old).split("\n")
                text += [rnd.choice(("> ", "> ", ">> ", "> > > ")) + x for x in q[:rnd.randint(1, len(q))]]
        own = [f"Line {rnd.randint(0, 40)} of someone, here." for _ in range(rnd.randint(0, 3))]
        text += own
        old.append("\n".join(text) or "nothing")
        out.append((conv, len(old) - 1, "\n".join(text)))
    return out


def test_against_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 8)
    messages = made(1)
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id long, turn long, role string, text string")
    want, rows = plain(messages), Q.conversations(df).collect()
    assert {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_linked"]) for r in rows} == want
    assert sum(p is not None for p, _ in want.values()) > 30
    for r in rows:
        assert r["thread_turn"] == thread(want, (r["conv_id"], r["turn"])) and ">" not in r["text"]
    for conv in {r["conv_id"] for r in rows}:
        ordered = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in ordered] == list(range(len(ordered)))
        assert [(r["thread_turn"], r["turn"]) for r in ordered] == sorted((r["thread_turn"], r["turn"]) for r in ordered)


def test_nested_levels_introductions_and_wrapped_quotes(spark):
    a = "First line of the message.\nIt goes on for a while here."
    b = "On Monday, A wrote:\n> First line of the\n> message. It goes on for a while here.\n\nI agree with this."
    c = "B wrote:\n> > First line of the message.\n> I agree with this.\nSo do I."
    df = spark.createDataFrame([(1, 0, "a", a), (1, 1, "b", b), (1, 2, "c", c), (1, 3, "d", "> never said by anyone\nok")],
                               "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in Q.conversations(df).collect()}
    assert [got[i]["parent_turn"] for i in range(4)] == [None, 0, 1, None]
    assert [got[i]["text"] for i in range(4)] == [a, "I agree with this.", "So do I.", "ok"]
    assert [got[i]["n_passages"] for i in range(4)] == [0, 1, 2, 1] and [got[i]["thread_turn"] for i in range(4)] == [0, 0, 0, 3]


def test_a_quote_of_the_second_level_only_links(spark):
    rows = [(1, 0, "the passage that is quoted"), (1, 1, "something else"), (1, 2, "> X wrote:\n>> the passage that is quoted\nyes"),
            (1, 3, ">>> yes\n> something else\nno"), (1, 4, "y" * 500 + " wrote:\n> no\nwell")]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in Q.conversations(df).collect()}
    assert [got[t]["parent_turn"] for t in range(5)] == [None, None, 0, 1, 3]
    assert [got[t]["n_linked"] for t in range(5)] == [0, 0, 1, 2, 1] and [got[t]["thread_turn"] for t in range(5)] == [0, 1, 0, 1, 1]
    assert got[4]["text"] == "well"


def test_table_without_quotes(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = Q.conversations(table)
    want = sorted((r["conv_id"], r["turn"], r["role"], r["turn"], r["text"]) for r in table.collect())
    assert sorted((r["conv_id"], r["turn"], r["role"], r["position"], r["text"]) for r in got.collect()) == want


def test_long_chain_of_replies(spark):
    rows = [(1, i, "x", f"> message {i - 1} says\nmessage {i} says") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Q.conversations(df).collect()
    assert {r["thread_turn"] for r in got} == {0} and all(r["position"] == r["turn"] for r in got)


def test_edge_cases(spark):
    rows = [(1, 0, None, None, 9), (1, 0, None, None, 9), (None, 1, "u", "said here", 9), (None, 2, "u", "> said here", 9), (2, None, "u", "> x", 9),
            (3, 0, "u", "", 9), (3, 1, "u", ">", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = sorted(((r["conv_id"], r["turn"], r["position"], r["parent_turn"], r["text"]) for r in Q.conversations(df).collect()), key=repr)
    assert got == sorted([(1, 0, 0, None, ""), (1, 0, 1, None, ""), (None, 1, 0, None, "said here"), (None, 2, 1, 1, ""), (2, None, 0, None, ""),
                          (3, 0, 0, None, ""), (3, 1, 1, None, "")], key=repr)
    assert Q.conversations(df.limit(0)).count() == 0
