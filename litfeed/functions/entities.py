"""HTML character references as column expressions.

Names come from the standard library's table of HTML5, handed to Spark as one constant text that is searched for the name;
numbers are decoded from their UTF-32 bytes. A text without ``&`` is left alone.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from litfeed.functions.binding import let

_START, _END = "\x01", "\x02"
#: Numbers 128 to 159 mean the characters of Windows-1252 (where it has one).
_WINDOWS = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0))
#: Names that also count without a semicolon, longest first.
_OPEN = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
_TABLE = _START + _START.join(k + _END + v for k, v in html5.items()) + _START


def _named(name: Column) -> Column:
    """What a name stands for; NULL for an unknown one."""
    at = F.instr(F.lit(_TABLE), F.concat(F.lit(_START), name, F.lit(_END)))
    return F.when((name != "") & (at > 0), F.split_part(F.substr(F.lit(_TABLE), at + F.length(name) + 2, F.lit(3)), F.lit(_START), F.lit(1)))


def _character(code: Column) -> Column:
    """The character of a code point; an unusable one is dropped or becomes the replacement character."""
    dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (
        code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    outside = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return (F.when(outside, F.lit("�")).when(code.between(0x80, 0x9F), F.substr(F.lit(_WINDOWS), (code - 127).cast("int"), F.lit(1)))
            .when(dropped, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def _reference(part: Column) -> Column:
    """A text that followed ``&``, with the reference at its start decoded."""
    decimal, hexed = F.regexp_extract(part, r"^#([0-9]+);?", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]+);?", 1)
    code = F.when(decimal != "", decimal.try_cast("bigint")).when(
        F.length(F.ltrim(hexed, F.lit("0"))) <= 8, F.conv(hexed, 16, 10).cast("bigint"))
    rest = lambda token: F.substr(part, F.length(token) + 1)

    def by_name(token: Column) -> Column:
        opened = F.regexp_extract(part, f"^(?:{'|'.join(_OPEN)})", 0)
        prefix = let(opened, lambda t: F.when(t != "", F.concat(_named(t), rest(t))).otherwise(F.concat(F.lit("&"), part)))
        return let(_named(token), lambda v: F.when(v.isNotNull(), F.concat(v, rest(token))).otherwise(prefix))

    number = F.regexp_extract(part, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
    return F.when(number != "", F.concat(let(code, _character), rest(number))).otherwise(
        let(F.regexp_extract(part, r"^[A-Za-z][A-Za-z0-9]*;", 0), by_name))


def unescape(col: Column, times: int = 1) -> Column:
    """Character references decoded, ``times`` over (the expression is built once)."""
    def fixed(text: Column) -> Column:
        parts = F.transform(F.split(text, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(_reference(part)))
        return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)
    if times > 1:
        return F.aggregate(F.array_repeat(F.lit(0), times), col, lambda text, _: fixed(text))
    return let(col, fixed)
