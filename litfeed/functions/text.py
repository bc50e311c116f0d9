"""Text cleaning and match normalisation (B-1, B-16, B-17 helpers, C-1)."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from litfeed.constants import HIDDEN_TAGS, SEPARATOR_TAGS
from litfeed.functions.binding import let
from litfeed.functions.compose import START, entry, nfc
from litfeed.functions.entities import unescape

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"

# Python's str.isspace() set, written for Java regex: ASCII controls + Unicode separators.
WS_CLASS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
# Characters that belong to a token: letters, numbers, marks, connector punctuation.
TOKEN_CLASS = r"\p{L}\p{N}\p{M}\p{Pc}"


def ascii_lower(col: Column) -> Column:
    """Case folding that touches ASCII letters only (SQLite LIKE semantics)."""
    return F.translate(col, UPPER_ASCII, LOWER_ASCII)


def collapse_ws(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"[{WS_CLASS}]+", " "))


# --- fixed values: full case-folding pairs where casefold differs from lower ---
CASEFOLD_EXTRA = (("ß", "ss"), ("ẞ", "ss"), ("ς", "σ"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"),
                  ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, str, str]:
    """From the standard library: characters beyond ASCII that fold to one other character, and these; those that fold to several (but
    for the common ones above) as a character class, and as a table of character and three characters of folding."""
    folds = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.casefold() != c}
    single = {c: f for c, f in folds.items() if len(f) == 1}
    several = {c: f for c, f in folds.items() if len(f) > 1 and c not in dict(CASEFOLD_EXTRA)}
    ranges: list[list[str]] = []
    for c in sorted(several):
        if ranges and ord(c) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return ("".join(single), "".join(single.values()), "".join(f"{a}-{b}" for a, b in ranges),
            "".join(START + c + f.ljust(3, "\0") for c, f in several.items()))


#: Texts of characters that are their own folding: ASCII, letters of Latin-1 and Cyrillic, dashes and quotes, Chinese characters.
_PLAIN = r"^[\x00-\x7F\u00A0-\u00B4\u00B6-\u00BF\u00E0-\u00FF\u0430-\u045F\u2010-\u2027\u3040-\u30FF\u4E00-\u9FFF]*+\z"


def casefold(col: Column) -> Column:
    """Full case folding, as ``str.casefold`` for every code point: ``lower``, the characters whose folding is not that, then those that
    fold to several. Texts of plain characters are only lower-cased. Characters newer than the standard library's Unicode version (27 of Unicode 16
    under Python 3.13) are lower-cased by Spark."""
    given, meant, many, table = _foldings()

    def expanded(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"[{many}]|[^{many}]+"), 0)
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.replace(entry(table, p, 3), F.lit("\0"), F.lit("")), p)), "")

    def full(low: Column) -> Column:
        out = F.translate(low, given, meant)
        for a, b in CASEFOLD_EXTRA:
            if len(b) > 1:
                out = F.replace(out, F.lit(a), F.lit(b))
        return let(out, lambda t: F.when(t.rlike(f"[{many}]"), expanded(t)).otherwise(t))

    return let(F.lower(col), lambda low: F.when(low.rlike(_PLAIN), low).otherwise(full(low)))


def match_normalize(col: Column) -> Column:
    """B-16: fold case, turn any dash or whitespace run into one space, trim.

    ``casefold`` is full folding, as ``str.casefold``.
    """
    return F.trim(F.regexp_replace(casefold(col), rf"[{WS_CLASS}\p{{Pd}}]+", " "))


#: A tag, comment or declaration; a name may carry a namespace prefix.
_MARKUP = r"(?s)<!--.*?(?:-->|\z)|<[!?][^>]*(?:>|\z)|</?[A-Za-z][^>]*>"
_TAG_NAME = r"^<(/?)(?:[\w.-]+:)?([A-Za-z][\w-]*)"
#: Hidden elements whose body holds no markup but their end tag.
_PLAIN_BODY = ("script", "style")


def _separated(markup: Column) -> Column:
    """Separator tags become spaces, all other markup goes."""
    names = "|".join(re.escape(t) for t in SEPARATOR_TAGS)
    spaced = F.regexp_replace(markup, rf"(?i)</?(?:[\w.-]+:)?(?:{names})(?=[\s/>])[^>]*>", " ")
    return F.regexp_replace(spaced, _MARKUP, "")


def _without_hidden(markup: Column) -> Column:
    """Bodies of hidden elements cut out, nested ones and unclosed ones too: the markup is cut into tags and text, and a
    fold over the pieces keeps the names of the hidden elements that are open (an end tag closes the innermost of its name)."""
    pieces = F.regexp_extract_all(markup, F.lit(rf"{_MARKUP}|[^<]+|<"), 0)
    name = lambda x: F.lower(F.regexp_extract(x, _TAG_NAME, 2))

    def step(state: Column, piece: Column) -> Column:
        def by_name(tag: Column) -> Column:
            inner = F.get(state["open"], 0)
            plain = F.coalesce(inner.isin(*_PLAIN_BODY), F.lit(False))
            hidden = tag.isin(*HIDDEN_TAGS) & (~plain | (tag == inner))
            ends = F.regexp_extract(piece, _TAG_NAME, 1) == "/"
            place = F.array_position(state["open"], tag).cast("int")
            closed = F.concat(F.slice(state["open"], F.lit(1), place - 1), F.slice(state["open"], place + 1, F.size(state["open"])))
            single = piece.rlike(r"/\s*>$")
            still = (F.when(hidden & ends & (place > 0), closed)
                     .when(hidden & ~ends & ~single & ~plain, F.concat(F.array(tag), state["open"])).otherwise(state["open"]))
            shown = F.when((F.size(state["open"]) == 0) & ~tag.isin(*HIDDEN_TAGS), F.concat(state["out"], F.array(piece))).otherwise(state["out"])
            return F.struct(still.alias("open"), shown.alias("out"))
        return let(name(piece), by_name)

    none = F.array().cast("array<string>")
    folded = F.aggregate(pieces, F.struct(none.alias("open"), none.alias("out")), step, lambda s: F.array_join(s["out"], ""))
    names = "|".join(HIDDEN_TAGS)
    return F.when(markup.rlike(rf"(?i)</?(?:[\w.-]+:)?(?:{names})\b"), folded).otherwise(markup)


def visible_text(col: Column) -> Column:
    """B-1 without composition: references decoded twice, hidden bodies out, separator tags as spaces, other markup out, white
    space collapsed, empty as NULL."""
    text = let(unescape(col, 2), lambda c: F.when(c.contains("<"), _separated(let(c, _without_hidden))).otherwise(c))
    return let(collapse_ws(text), lambda t: F.when(t != "", t))


def clean_text(col: Column) -> Column:
    """B-1: the visible text in composed form."""
    return nfc(visible_text(col))


def match_normalize_exact(col: Column) -> Column:
    """B-16 on composed text."""
    return match_normalize(nfc(col))


def placeholder_key(col: Column) -> Column:
    """Lower-case, drop punctuation, collapse whitespace (B-17 key)."""
    return collapse_ws(F.regexp_replace(casefold(col), r"\p{P}", ""))
