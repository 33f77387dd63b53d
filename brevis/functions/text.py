"""Text and number functions with the semantics of the source rules: UTF-16 lengths, ASCII word
boundaries, a fixed white-space class and half-up rounding. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space of the text rules (ASCII, NBSP, BOM and Unicode space separators).
SPACE = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: The same class, character by character.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_BREAK = r"\r?\n"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(text: str | Column) -> Column:
    return F.btrim(_col(text), F.lit(SPACES))


def utf16_length(text: str | Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond U+FFFF."""
    c = _col(text)
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def estimate_tokens(text: str | Column) -> Column:
    """A quarter of the trimmed length, rounded up; 0 for null."""
    return F.coalesce(F.ceil(utf16_length(trimmed(text)) / 4), F.lit(0)).cast("bigint")


def to_fixed(x: Column, digits: int) -> Column:
    """Rounding half away from zero to ``digits`` decimals."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def base36(n: str | Column) -> Column:
    return F.lower(F.conv(_col(n).cast("string"), 10, 36))


def lines(text: str | Column) -> Column:
    return F.split(_col(text), LINE_BREAK)


def saving(original: str | Column, compressed: str | Column) -> tuple[Column, Column]:
    """(ratio to two decimals, share saved to three) of token counts."""
    a, b = _col(original), _col(compressed)
    return F.when(b > 0, to_fixed(a / b, 2)).otherwise(1.0), F.when(a > 0, to_fixed(1 - b / a, 3)).otherwise(0.0)
