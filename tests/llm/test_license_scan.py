"""License rules: base places against brute force, rule order, suppression, edge cases."""

import random
import re
from math import prod

import pytest

from litfeed.llm import license_scan as L

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r)[1:6] for r in L.scan(docs).drop("labels").collect()}
    assert got == {r["doc_id"]: brute_base(r["text"]) for r in docs.collect()}


def test_base_against_brute_force():
    rnd = random.Random(3)
    vocabulary = ["cc", "by", "CC", "all", "rights", "reserved", "General", "public", "license", "é", "x1"]
    for _ in range(400):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", ".", "\n", "-", "  ", "_", ""]) for _ in range(rnd.randint(0, 30)))
        got = L.scan_text(text.encode())
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_base(text)


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}), ("Released under the MIT License.", {"mit"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc-4.0"}), ("under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}), ("GNU Lesser General Public License v2.1", {"gpl", "lgpl-2.1"}),
    ("Copyright (c) 2020 Some One. All rights reserved.", {"copyright", "reserved"}), ("mit der Zeit", set()), ("public by the rights", set()),
    ("This is dedicated to the public domain", {"public-domain"}), ("Creative Commons Attribution-ShareAlike 4.0", {"cc-by-sa-4.0"}),
    ("CC BY 4.0", {"cc-by", "cc-by-4.0"})])
def test_labels(text, labels):
    got = L.scan_text(text.encode())
    assert set(filter(None, got["labels"].split(","))) == labels
    assert set(filter(None, got["base_labels"].split(","))) <= labels
    assert 0 <= got["score"] <= 1 and (got["score"] > 0) == bool(got["detections"])


def test_contained_detections_are_suppressed_by_priority():
    joined, _ = L.stream(b"x Licensed under the Apache License, Version 2.0, all rights reserved; Apache License")
    found = L.detect(joined)
    assert [(d.label, d.first, d.last) for d in found] == [("apache-2.0", 1, 8), ("reserved", 9, 11), ("apache", 12, 13)]
    for a in found:
        for b in found:
            assert a is b or not (b.first <= a.first and a.last <= b.last)


def test_every_rule_is_opened_by_its_keywords():
    """A text that a rule matches holds one of the rule's keywords: taken from rules' own plain names."""
    assert 200 < len(L.rules())
    for f in L.FAMILIES:
        for name in re.findall(r"[a-z0-9]+(?: [a-z0-9]+)+", f.name):
            text = f" licensed under the {name} ".encode()
            for r in L.rules():
                if r.pattern.search(text):
                    assert any(k.encode() in text for k in r.keywords), (r.label, text)


def spelled(pattern):
    """All texts of a pattern (an optional part or a character class: each way)."""
    from itertools import product
    from re import _parser as P

    def ways(items):
        parts = []
        for op, value in items:
            kind = str(op)
            if kind == "LITERAL":
                parts.append([chr(value)])
            elif kind == "IN":
                parts.append([chr(v) for k, v in value if str(k) == "LITERAL"] or ["7"])
            elif kind == "BRANCH":
                parts.append([w for x in value[1] for w in ways(x)])
            elif kind == "SUBPATTERN":
                parts.append(ways(value[3]))
            elif kind == "MAX_REPEAT":
                parts.append(sorted({w * k for w in ways(value[2]) for k in {value[0], 1}}))
            else:
                assert kind in ("ASSERT", "ASSERT_NOT"), kind
        return ["".join(x) for x in product(*parts)]
    return ways(P.parse(pattern))


def test_keywords_open_the_rules_of_every_form_and_name():
    for f in L.FAMILIES:
        for form, _, _ in L.FORMS:
            if "{ident}" in form and not f.ident:
                continue
            for text in {f" {x} " for x in spelled(form.format(name=f"(?:{f.name})", ident=f"(?:{f.ident})"))}:
                for r in L.rules():
                    if r.label.startswith(f.label) and r.pattern.search(text.encode()):
                        assert any(k in text for k in r.keywords), (r.label, text)


def test_short_names_are_found():
    for text in (b"released under a MIT-style license", b"licensed under the terms of the MIT"):
        assert L.scan_text(text)["labels"] == "mit" and L.scan_text(text)["score"] > 0.8
    assert L.scan_text(b"licensed under CC Attribution 4.0 now")["labels"] == "cc-by-4.0"


@pytest.mark.parametrize("text, labels", [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
    ("// SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) OR CC0-1.0", {"gpl-2.0-or-later", "bsd-3-clause", "cc0-1.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only\nmit der Zeit", {"gpl-2.0-only"}), ("GPL-2.0-or-later", {"gpl-2.0-or-later"}),
    ("Affero GPL v3+", {"agpl-3.0-or-later"}), ("GNU General Public Licence version 3", {"gpl-3.0"}), ("MIT licence", {"mit"}),
    ("under the terms of the GNU Lesser GPL, version 2.1 only", {"lgpl-2.1-only"}), ("GNU GPL v2.", {"gpl-2.0"}),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
     {"gpl", "gpl-3.0-or-later"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl", "mpl-2.0"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("Copyright 2020 A B C D E F G H I. All rights reserved", {"copyright", "reserved"}), ("C++ 3+4 gpl+", {"gpl"})])
def test_statements_as_they_are_written(text, labels):
    assert set(filter(None, L.scan_text(text.encode())["labels"].split(","))) == labels


def test_rule_stream_has_the_words_of_the_base():
    rnd = random.Random(8)
    for _ in range(2000):
        text = "".join(rnd.choice(["+", "3", "a", " ", "licence", "é", ".", "-"]) for _ in range(rnd.randint(0, 12))).encode()
        assert len(L.rule_stream(text).split()) == L.stream(text)[1], text


def test_suppression_against_a_plain_model():
    """Every rule is run without the keyword gate, and every detection taken is compared with every other."""
    rnd = random.Random(5)
    pieces = ["SPDX-License-Identifier:", "MIT", "OR", "Apache-2.0", "GPL-2.0-or-later", "under the terms of the", "GNU", "Lesser",
              "General Public License", "version 2.1", "v3+", "only", "licensed under", "CC BY-SA 4.0", "Copyright 2021 Ann",
              "All rights reserved", "public domain", "word", "mit"]
    whole, inside = L.expression()
    taken_any = 0
    for _ in range(300):
        joined = L.rule_stream(" ".join(rnd.choices(pieces, k=rnd.randint(1, 14))).encode())
        spans = [m.span() for m in whole.finditer(joined)]
        found = [(r, m) for r in L.rules() for m in r.pattern.finditer(joined)]
        found += [(r, m) for r in inside for a, b in spans for m in r.pattern.finditer(joined, a, b + 1)]
        found.sort(key=lambda x: (-x[0].priority, x[1].start() - x[1].end(), x[1].start(), x[0].order))
        taken = []
        for r, m in found:
            if not any(a <= m.start() and m.end() <= b for _, a, b in taken):
                taken.append((r, m.start(), m.end()))
        want = sorted((joined[:a].count(b" ") - 1, joined[:b].count(b" ") - 1, r.label) for r, a, b in taken)
        got = L.detect(joined)
        assert sorted((d.first, d.last, d.label) for d in got) == want
        miss = 1.0
        for r, _, _ in taken:
            miss *= 1 - r.confidence
        assert abs((1 - miss) - (1 - prod(1 - d.confidence for d in got))) < 1e-12
        taken_any += len(taken)
    assert taken_any > 300


def test_many_detections_in_one_text_are_fast():
    got = L.scan_text(b"cc by " * 50_000)
    assert got["n_base"] == 50_000 and len(got["detections"]) == 50_000 and got["last_word"] == 99_998


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "CC BY", "c"), (None, "CC BY", "c")], "doc_id long, text string, labels string")
    got = [tuple(r)[:7] for r in L.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, 0, None, None, "", "")] * 2 + [(None, 2, 1, 0, 0, "cc-by", "cc-by")] * 2, key=repr)
    assert L.scan(df.limit(0)).count() == 0
