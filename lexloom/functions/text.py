"""Column builders over text: folding, tokens, offsets. Offsets are code points, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits, underscore and combining marks; words hold together over a hyphen or a point.
UNIT = r"[\p{L}\p{N}_\x{0300}-\x{036f}]+"
WORD = f"{UNIT}(?:[-.]{UNIT})*"
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: str | Column) -> Column:
    """Case folding of composed text."""
    return F.replace(F.lower(col(x)), F.lit("ß"), F.lit("ss"))


def ascii_fold(x: str | Column) -> Column:
    """Lower case without accents; what is not ASCII then is dropped."""
    return F.regexp_replace(F.translate(F.lower(col(x)), ACCENTED, PLAIN), r"[^\x00-\x7f]", "")


def tokens(x: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(x)), F.lit(WORD), F.lit(0))


def marked(x: str | Column, pattern: str) -> Column:
    """The text cut at the pattern's matches: matches at the odd places, what lies between at the even ones."""
    return F.split(F.regexp_replace(col(x), f"({pattern})", "\u0001$1\u0002"), "[\u0001\u0002]")
