"""Column twins of the transforms that are plain rewrites, and spans of a pattern with their places.

Patterns keep to what Java's and RE2's dialects share, so that the same rewrites can be checked in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from piispan.functions.normalize import AT_DOT, FRACTIONS, HOMOGLYPH_DIGITS, ROT_MARK, SPOKEN_DIGITS, grouped

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Patterns and replacements of digit groups: social security numbers, cards of 16 and of 15 digits.
SEGMENT_STEPS = ((grouped((3, 2, 4), r"[\s_]"), "$1-$2-$3"), (grouped((4, 4, 4, 4), r"[_.\s-]"), "$1 $2 $3 $4"), (grouped((4, 6, 5), r"[_.\s-]"), "$1 $2 $3"))


def _sub(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def tight_at_dot(c: Column) -> Column:
    return _sub(c, (r"\s+@\s+", "@"), (r"\s+@", "@"), (r"@\s+", "@"), (r"\s+\.\s+", "."), (r"\s+\.", "."))


def at_dot(c: Column) -> Column:
    """Bracketed at and dot to their symbols, white space around them gone."""
    for written, symbol in AT_DOT:
        quoted = "".join("\\" + x if x in "[](){}.<>@" and x not in "<>@" else x for x in written)
        c = F.regexp_replace(c, "(?i)" + quoted, symbol)
    return tight_at_dot(c)


def url_protocol(c: Column) -> Column:
    return _sub(c, (r"(?i)\bhxxps://", "https://"), (r"(?i)\bhxxp://", "http://"), (r"\b(https?)\s*:\s*//", "$1://"), (r"\b(https?://)\s+", "$1"))


def spoken(c: Column) -> Column:
    c = reduce(lambda x, w: F.regexp_replace(x, rf"(?i)\b{w}\b", SPOKEN_DIGITS[w]), SPOKEN_DIGITS, c)
    return _sub(c, (r"(?i)\b(?:hyphen|dash)\b", "-"), (r"(?i)\b(?:point|dot)\b", "."))


def fractions(c: Column) -> Column:
    return reduce(lambda x, f: F.replace(x, F.lit(f), F.lit(FRACTIONS[f])), FRACTIONS, c)


def translated(c: Column) -> Column:
    """Look-alike digits, dashes and full-width characters, one for one."""
    wide = [chr(x) for x in range(0xFF01, 0xFF5F)]
    return F.translate(c, "".join(HOMOGLYPH_DIGITS) + "–—" + "".join(wide), "".join(HOMOGLYPH_DIGITS.values()) + "--" + "".join(chr(ord(x) - 0xFEE0) for x in wide))


def removed(c: Column) -> Column:
    """Comments, zero-width characters, soft hyphens, katakana."""
    return _sub(c, (r"<!--.*?-->", ""), ("[​‌‍﻿­゠-ヿ･-ﾟ]", ""))


def segments(c: Column) -> Column:
    return _sub(c, *SEGMENT_STEPS)


def without_inner_separators(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[0-9])[^\p{L}\p{N}_\n]+(?=[0-9])", "")


def rot13(c: Column) -> Column:
    turned = F.translate(c, _LOWER + _UPPER, _LOWER[13:] + _LOWER[:13] + _UPPER[13:] + _UPPER[:13])
    return F.when(c.rlike(ROT_MARK), turned).otherwise(c)


def private_url(url: Column) -> Column:
    """A private prefix, or a host without a dot."""
    host = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^@/]*@)?([^/:?#]+)", 1)
    private = url.rlike(r"(?i)^https?://(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)") | url.rlike(r"(?i)\.(?:internal|local|corp|lan|intranet)(?:[:/]|$)")
    return private | ((host != "") & ~host.contains("."))


_OPEN, _CLOSE = "\x01", "\x02"
FOUND = "array<struct<value:string,start:int,end:int>>"


def spans_of(text: Column, pattern: str) -> Column:
    """All matches with their places: matches are bracketed by two control characters, and the pieces' lengths add up."""
    none = F.expr(f"cast(array() as {FOUND})")
    clean = F.translate(text, _OPEN + _CLOSE, "\x03\x03")
    pieces = F.split(F.regexp_replace(clean, "(" + pattern + ")", f"{_OPEN}$1{_CLOSE}"), _OPEN)
    empty = F.struct(F.length(pieces[0]).cast("int").alias("at"), none.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        value = F.substring_index(piece, _CLOSE, 1)
        end = (acc["at"] + F.length(value)).cast("int")
        found = F.struct(value.alias("value"), acc["at"].alias("start"), end.alias("end"))
        return F.struct((acc["at"] + F.length(piece) - 1).cast("int").alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    found = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), empty, step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(none)
