"""Canonical composition (NFC) as column expressions, from tables that the standard library's Unicode data give."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from litfeed.functions.binding import let

_PLANE = range(0x80, 0x10000)
START = "\x01"


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str, str]:
    """Base, mark and composed character, one entry after the other; a mark and its class; characters that another one
    stands for, and these."""
    pairs, single = {}, {}
    for c in map(chr, _PLANE):
        parts = unicodedata.decomposition(c).split()
        if parts and not parts[0].startswith("<"):
            apart, whole = "".join(chr(int(p, 16)) for p in parts), unicodedata.normalize("NFC", c)
            if len(parts) == 2 and whole == c:
                pairs[apart] = c
            elif len(whole) == 1 and whole != c:
                single[c] = whole
    classes = "".join(f"{START}{c}{unicodedata.combining(c):03d}" for c in map(chr, _PLANE) if unicodedata.combining(c))
    return "".join(START + k + v for k, v in pairs.items()), classes, "".join(single), "".join(single.values())


def entry(table: str, key: Column, size: int) -> Column:
    """The ``size`` characters that follow a key of known length in a table."""
    at = F.instr(F.lit(table), F.concat(F.lit(START), key))
    return F.when(at > 0, F.substr(F.lit(table), at + F.length(key) + 1, F.lit(size)))


def _cluster(text: Column) -> Column:
    """A character with its marks: marks in the order of their classes, then joined to the character while they can be."""
    pairs, classes, _, _ = _tables()
    marks = F.sort_array(F.transform(F.split(F.substr(text, F.lit(2)), ""), lambda m, i: F.struct(
        F.coalesce(entry(classes, m, 3).cast("int"), F.lit(0)).alias("c"), i.alias("i"), m.alias("m"))))

    def step(s: Column, m: Column) -> Column:
        def joined(whole: Column) -> Column:
            free = whole.isNotNull() & (s["last"] != m["c"])
            return F.struct(F.when(free, whole).otherwise(s["base"]).alias("base"),
                            F.when(free, s["rest"]).otherwise(F.concat(s["rest"], m["m"])).alias("rest"),
                            F.when(free, s["last"]).otherwise(m["c"]).alias("last"))
        return let(entry(pairs, F.concat(s["base"], m["m"]), 1), joined)

    start = F.struct(F.substring(text, 1, 1).alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))
    return F.aggregate(marks, start, step, lambda s: F.concat(s["base"], s["rest"]))


def nfc(col: Column) -> Column:
    """Composed form of a text (basic plane). Texts without characters that composition concerns are left alone."""
    _, _, given, meant = _tables()

    def composed(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}+|\p{M}+|(?:\P{M}(?!\p{M}))+"), 0)
        fixed = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\P{M}\p{M}"), _cluster(p)).otherwise(p)), "")
        return F.when(text.rlike(r"\p{M}"), fixed).otherwise(text)

    return let(let(col, lambda c: F.when(c.rlike(r"[̀-￿]"), F.translate(c, given, meant)).otherwise(c)), composed)
