"""License scan with ordered signature rules.

Texts are lower-cased (A-Z) and cut into words; rules are regular expressions over the words joined by one space, so a
place in a text is a word interval. Hundreds of rules come from hand-written license families times statement
forms. A text is searched for the keywords first; a rule runs only where its keywords occur. Detections are taken
by priority, then length, then place; one whose interval lies within that of a detection already taken is suppressed
(``all rights reserved`` within a BSD notice, ``gnu general public license`` within its versioned form).

Rules read ``licence`` as ``license`` and keep a ``+`` behind a version (``GPL v3+``), which then means "or later"; the words of the
base are not changed by that. An SPDX expression is read to its end: each identifier joined by ``or`` or ``and`` gives its label.
GNU licenses have labels for ``-only`` and ``-or-later``. A copyright notice and ``all rights reserved`` are one detection if a
holder of up to ``HOLDER_WORDS`` words stands between them, and two detections beyond, so neither is lost.

Base phrases (``cc by``, ``general public license``, ``all rights reserved``) are counted at every place, overlapping or not,
and their labels always stay. Score: ``1 - prod(1 - confidence)`` over detections taken (0: none).

Edge cases: null text is empty; rows are independent, so repeated rows and null ids are kept as they are; other columns
do not matter; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.llm.common import fresh

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Family(NamedTuple):
    """A license: label, name as a pattern over words, keywords (one of them is in every match), versions (empty: none),
    short identifier pattern."""
    label: str
    name: str
    keywords: tuple[str, ...]
    versions: tuple[str, ...] = ()
    ident: str = ""


FAMILIES = (
    Family("apache", r"apache(?: software)? license|apache", ("apache",), ("1.0", "1.1", "2.0"), r"apache"),
    Family("mit", r"mit(?: x11)?(?: license)?|expat license", (" mit ", " expat license"), (), r"mit"),
    Family("mit-0", r"mit no attribution(?: license)?", ("no attribution",), (), r"mit 0"),
    Family("bsd-2-clause", r"(?:2 clause|simplified|freebsd) bsd(?: license)?|bsd 2 clause(?: license)?", ("bsd",), (), r"bsd 2 clause"),
    Family("bsd-3-clause", r"(?:3 clause|new|modified|revised) bsd(?: license)?|bsd 3 clause(?: license)?", ("bsd",), (), r"bsd 3 clause"),
    Family("bsd-4-clause", r"(?:4 clause|original) bsd(?: license)?|bsd 4 clause(?: license)?", ("bsd",), (), r"bsd 4 clause"),
    Family("bsd", r"bsd(?: style)? license", ("bsd",)),
    Family("0bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?", ("bsd",), (), r"0bsd"),
    Family("gpl", r"(?:gnu )?general public license|gnu gpl|gpl", ("general public license", " gpl "), ("1.0", "2.0", "3.0"), r"gpl"),
    Family("lgpl", r"(?:gnu )?(?:lesser|library) (?:general public license|gpl)|gnu lgpl|lgpl",
           ("lesser general public", "library general public", "lesser gpl", "library gpl", " lgpl "), ("2.0", "2.1", "3.0"), r"lgpl"),
    Family("agpl", r"(?:gnu )?affero (?:general public license|gpl)|gnu agpl|agpl", ("affero general public", "affero gpl", " agpl "), ("1.0", "3.0"), r"agpl"),
    Family("gfdl", r"(?:gnu )?free documentation license|gfdl", ("free documentation license", " gfdl "), ("1.1", "1.2", "1.3"), r"gfdl"),
    Family("mpl", r"mozilla public license|mpl", ("mozilla public license", " mpl "), ("1.0", "1.1", "2.0"), r"mpl"),
    Family("epl", r"eclipse public license|epl", ("eclipse public license", " epl "), ("1.0", "2.0"), r"epl"),
    Family("eupl", r"european union public licen[cs]e|eupl", ("european union public", " eupl "), ("1.0", "1.1", "1.2"), r"eupl"),
    Family("cddl", r"common development and distribution license|cddl", ("common development and distribution", " cddl "), ("1.0", "1.1"), r"cddl"),
    Family("cpl", r"common public license", ("common public",), ("1.0",), r"cpl"),
    Family("osl", r"open software license", ("open software",), ("1.0", "2.0", "2.1", "3.0"), r"osl"),
    Family("afl", r"academic free license", ("academic free",), ("1.1", "1.2", "2.0", "2.1", "3.0"), r"afl"),
    Family("artistic", r"artistic license", ("artistic license",), ("1.0", "2.0"), r"artistic"),
    Family("isc", r"isc license", (" isc license", "identifier isc"), (), r"isc"),
    Family("zlib", r"zlib(?: libpng)? license", ("zlib",), (), r"zlib"),
    Family("boost", r"boost software license", ("boost software",), ("1.0",), r"bsl"),
    Family("python", r"python software foundation license|psf license", ("python software foundation", " psf "), ("2.0",), r"psf|python"),
    Family("postgresql", r"postgresql licen[cs]e", ("postgresql",), (), r"postgresql"),
    Family("unlicense", r"unlicense", ("unlicense",), (), r"unlicense"),
    Family("wtfpl", r"do what the fuck you want to public license|wtfpl", ("do what the fuck", " wtfpl "), (), r"wtfpl"),
    Family("ms-pl", r"microsoft public license", ("microsoft public",), (), r"ms pl"),
    Family("ms-rl", r"microsoft reciprocal license", ("microsoft reciprocal",), (), r"ms rl"),
    Family("ofl", r"(?:sil )?open font license", ("open font",), ("1.0", "1.1"), r"ofl"),
    Family("odbl", r"open (?:data commons open )?database license|odbl", ("database license", " odbl "), ("1.0",), r"odbl"),
    Family("odc-by", r"open data commons attribution license", ("open data commons",), ("1.0",), r"odc by"),
    Family("pddl", r"public domain dedication and license", ("public domain",), ("1.0",), r"pddl"),
    Family("ogl-uk", r"open government licen[cs]e", ("open government",), ("1.0", "2.0", "3.0"), r"ogl uk"),
    Family("bsl", r"business source license", ("business source",), ("1.0", "1.1"), r"busl"),
    Family("sspl", r"server side public license", ("server side",), ("1.0",), r"sspl"),
    Family("elastic", r"elastic license", ("elastic license",), ("2.0",), r"elastic"),
    Family("openrail", r"openrail m?(?: license)?|responsible ai license", ("openrail", "responsible ai license"), (), r"openrail"),
    Family("cc0", r"cc0|cc zero|creative commons zero", (" cc0 ", " cc zero ", "creative commons zero"), ("1.0",), r"cc0"),
    *(Family("cc-" + "-".join(terms), r"(?:cc|creative commons) (?:" + " ".join(terms) + "|" + " ".join(
        {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s", "sa": "share ?alike"}[t] for t in terms)
        + r")(?= )(?! (?:nc|nd|sa|non ?commercial|no ?deriv|share ?alike))", (" cc ", "creative commons "), ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc " + " ".join(terms))
      for terms in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))),
)

#: Statement forms around a license name: pattern, priority, confidence. Higher priority wins.
FORMS = (
    (r"spdx license identifier {ident}", 90, 1.0),
    (r"(?:is |are |be )?(?:dual |re)?licen[cs]ed under (?:the |a )?(?:terms of the )?{name}(?: license)?", 80, 0.95),
    (r"(?:released|distributed|published|available|provided|made available) under (?:the |a )?(?:terms of the )?{name}(?: license)?",
     80, 0.95),
    (r"(?:subject to|under) the terms (?:and conditions )?of the {name}", 70, 0.9),
    (r"{name}", 40, 0.6),
)

#: Families whose versions come as "only" and "or later".
GNU = ("gpl", "lgpl", "agpl", "gfdl")
#: The most words of a holder's name between a copyright year and "all rights reserved" in one detection.
HOLDER_WORDS = 6

#: Other notices: label, pattern, keywords (one of them is in every match), priority, confidence.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("hereby granted",), 95, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", ("permission to use",), 95, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", ("redistribution and use",), 95, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", ("implied warranty",), 95, 0.9),
    ("gpl", r"this program is free software you can redistribute it and or modify it", ("free software",), 95, 0.95),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", ("free software",), 95, 0.95),
    ("bsd-3-clause", r"contributors may be used to endorse or promote products derived from this software", ("used to endorse",), 95, 0.9),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy", ("hereby granted",), 95, 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered software",), 95, 1.0),
    ("wtfpl", r"you just do what the fuck you want to", ("do what the fuck",), 95, 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee",
     ("permission to use",), 95, 0.95),
    ("apache", r"you may not use this file except in compliance with the license", ("compliance with the license",), 95, 0.8),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", ("mozilla public license",), 60, 0.95),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license",
     ("eclipse public license",), 60, 0.95),
    ("openssl", r"this product includes software developed by the openssl project", ("openssl project",), 95, 0.95),
    ("ofl", r"this font software is licensed under the sil open font license", ("open font",), 60, 0.95),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", ("with this deed",), 95, 1.0),
    ("public-domain", r"(?:released|dedicated|placed)? ?(?:in|in ?to|to)? ?the public domain", ("public domain",), 60, 0.7),
    ("proprietary", r"confidential and proprietary|proprietary and confidential|trade secrets? of", ("proprietary", "trade secret"), 60, 0.8),
    ("proprietary", r"no part of this (?:publication|work|document) may be reproduced", ("no part of this",), 75, 0.9),
    ("copyright", rf"(?:copyright|©)(?: c)? (?:(?:19|20)[0-9][0-9]\+? ?)+(?:[^ ]+ ){{0,{HOLDER_WORDS}}}?all rights reserved", ("rights reserved",), 65, 0.9),
    ("copyright", r"copyright(?: c)? (?:19|20)[0-9][0-9]\+?", ("copyright",), 50, 0.6),
    ("reserved", r"all rights reserved", ("rights reserved",), 30, 0.5),
)


class Rule(NamedTuple):
    order: int
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float


def _number(v: str) -> str:
    major, minor = v.split(".")
    return major + (rf"(?: {minor})?" if minor == "0" else f" {minor}")


_LATER = (r"(?:\+| of the license| or later)*(?:\+| or later| or newer|(?: or)?(?: at your option)? any later)"
          r"(?: versions?)?")


def _versions(f: Family) -> Iterator[tuple[str, str, int]]:
    """What may follow a name: label's end, pattern, how much it adds to the priority (the fuller statement wins)."""
    before = (r"(?: only| license| international| unported)?(?: as published by the free software foundation)?(?: either)?"
              r"(?: version| v|,)? ?v?")
    for v in f.versions:
        yield f"-{v}", before + _number(v) + r"\+?", 5
        if f.label in GNU:
            yield f"-{v}-only", before + _number(v) + "(?: of the license)? only", 6
            yield f"-{v}-or-later", before + _number(v) + _LATER, 6


def _rule(order: int, label: str, pattern: str, keys: tuple[str, ...], priority: int, confidence: float) -> Rule:
    return Rule(order, label, re.compile((r"(?<= )(?:" + pattern + r")(?= )").encode()), keys, priority, confidence)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules over the words, in their order (compiled once a process)."""
    found = list(NOTICES)
    for f in FAMILIES:
        for form, priority, confidence in FORMS:
            if "{ident}" in form and not f.ident:
                continue
            core, keys = form.format(ident=f"(?:{f.ident})", name=f"(?:{f.name})"), f.keywords
            if "{ident}" in form:
                keys = (SPDX,)
            elif form == "{name}" and f.label == "mit":  # the bare word is no statement
                core = r"mit(?: x11)? license|expat license"
            elif form == "{name}" and f.label == "apache":
                core = r"apache(?: software)? license"
            found.append((f.label, core, keys, priority, confidence))
            for end, follows, more in _versions(f):  # a version makes a statement more certain, and its rule comes first
                found.append((f.label + end, f"(?:{core})" + follows, keys, priority + more, min(1.0, confidence + 0.05)))
    return tuple(_rule(i, *r) for i, r in enumerate(found))


#: What opens an SPDX expression, in words.
SPDX = "spdx license identifier"


@lru_cache(maxsize=1)
def expression() -> tuple[re.Pattern, tuple[Rule, ...]]:
    """An SPDX expression of known identifiers joined by ``or`` and ``and``, and the rules that hold inside one."""
    found = []
    for f in FAMILIES:
        if f.ident:
            found.append((f.label, f.ident, (SPDX,), 89, 1.0))
            for v in f.versions:
                exact = f"(?:{f.ident}) {_number(v)}"
                found.append((f"{f.label}-{v}", exact + r"\+?", (SPDX,), 94, 1.0))
                if f.label in GNU:
                    found.append((f"{f.label}-{v}-only", exact + " only", (SPDX,), 95, 1.0))
                    found.append((f"{f.label}-{v}-or-later", exact + r"(?:\+| or later)", (SPDX,), 95, 1.0))
    start = len(rules())
    one = "(?:" + "|".join(f"(?:{f.ident})" for f in sorted(FAMILIES, key=lambda f: -len(f.ident)) if f.ident)
    one += r")(?: [0-9]+)*\+?(?: only| or later)?(?= )"
    whole = re.compile(f"(?<= ){SPDX} {one}(?: (?:or|and) {one})*".encode())
    return whole, tuple(_rule(start + i, *r) for i, r in enumerate(found))


@lru_cache(maxsize=1)
def prefilter():
    """An automaton over all keywords; a match gives the numbers of the rules that it opens."""
    import ahocorasick
    by_keyword: dict[str, list[int]] = {}
    for r in rules():
        for k in r.keywords:
            by_keyword.setdefault(k, []).append(r.order)
    automaton = ahocorasick.Automaton()
    for k, orders in by_keyword.items():
        automaton.add_word(k, (k, orders))
    automaton.make_automaton()
    return automaton


_WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_RULE_BYTES = bytes(43 if c == 43 else _WORD_BYTES[c] for c in range(256))
#: A plus that is no part of a version.
_OTHER_PLUS = re.compile(rb"(?<![0-9])\+|\+(?=[0-9A-Za-z\x80-\xff])")


class Detection(NamedTuple):
    first: int
    last: int
    label: str
    priority: int
    confidence: float


def stream(text: bytes) -> tuple[bytes, int]:
    """The words of a text, each between spaces, and their number."""
    words = text.translate(_WORD_BYTES).split()  # spaces are the only white space left
    return b" " + b" ".join(words) + b" ", len(words)


def rule_stream(text: bytes) -> bytes:
    """The stream that rules read, of as many words: British spelling as American, a plus kept behind a version."""
    if b"+" in text:
        text = _OTHER_PLUS.sub(b" ", text)
    return (b" " + b" ".join(text.translate(_RULE_BYTES).split()) + b" ").replace(b" licence", b" license")


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which a phrase stands (places may overlap)."""
    found, at, words, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        found.append(words)
        at = joined.find(phrase, at + 1)
    return found


def matches(joined: bytes) -> list[tuple]:
    """All matches of the opened rules: priority and length (negative), start, rule, end, detection."""
    opened = {k: orders for _, (k, orders) in prefilter().iter(joined.decode(errors="replace"))}
    whole, inside = expression()
    everywhere = [(0, len(joined))]
    work = [(rules()[order], everywhere) for order in {x for orders in opened.values() for x in orders}]
    if SPDX in opened:
        spans = [(m.start(), m.end() + 1) for m in whole.finditer(joined)]
        work += [(r, spans) for r in inside]
    found = []
    for r, spans in work:
        first, seen = -1, 0
        for lo, hi in spans:
            for m in r.pattern.finditer(joined, lo, hi):
                first += joined.count(b" ", seen, m.start())
                seen = m.start()
                found.append((-r.priority, -(m.end() - m.start()), m.start(), r.order, m.end(),
                              Detection(first, first + m[0].count(b" "), r.label, r.priority, r.confidence)))
    return found


def detect(joined: bytes) -> list[Detection]:
    """Detections taken in the rule stream of a text, in order of place."""
    found = matches(joined)
    # by priority; the furthest end of a taken detection that starts no later, from a tree of prefix maxima
    place = {a: i + 1 for i, a in enumerate(sorted({x[2] for x in found}))}
    furthest, taken = [0] * (len(place) + 1), []
    for _, _, a, _, b, d in sorted(found):
        i, end = place[a], 0
        while i:
            end, i = max(end, furthest[i]), i & (i - 1)
        if end < b:
            taken.append(d)
            i = place[a]
            while i <= len(place):
                furthest[i] = max(furthest[i], b)
                i += i & -i
    return sorted(taken)


def scan_text(text: bytes) -> dict:
    joined, n = stream(text)
    base = {p: _places(joined, f" {p} ".encode()) for p in PHRASES}
    places = [x for found in base.values() for x in found]
    detections = detect(rule_stream(text))
    miss = 1.0
    for d in detections:
        miss *= 1 - d.confidence
    labels = {PHRASES[p] for p, found in base.items() if found}
    return {"n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {d.label for d in detections})),
            "score": 1 - miss, "detections": [d._asdict() for d in detections]}


FIELDS = (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"),
          ("labels", "string"), ("score", "double"),
          ("detections", "array<struct<first:long,last:long,label:string,priority:int,confidence:double>>"))
_DETECTIONS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("priority", pa.int32()),
                                  ("confidence", pa.float64())]))
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def scan(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: base counts, labels, score, and the detections as word intervals."""
    where = fresh(docs, "_text")
    given = docs.select(F.col(ident).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(where))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan_text(x.as_py()) for x in b.column(1)]
            arrays = [pa.array([g[name] for g in got], _ARROW.get(t, _DETECTIONS)) for name, t in FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", *(name for name, _ in FIELDS)])

    return given.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{a} {t}" for a, t in FIELDS))
