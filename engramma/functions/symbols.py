"""Column functions on symbols: the normal form of codes and safe text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_code(c: Column | str) -> Column:
    """Lower case; runs of anything but letters, digits and ``_`` become one ``_``; no ``_`` at either end.

    Null stays null; a string without any symbol character becomes the empty string.
    """
    # \p{L}\p{N} is what a word character is in the normal form; Java's (?U)\w would also take combining marks
    return F.regexp_replace(F.regexp_replace(F.lower(col_of(c)), r"[^\p{L}\p{N}_]+", "_"), r"^_+|_+$", "")


def blank(c: Column | str) -> Column:
    """True for null and for text without any visible character."""
    return F.coalesce(~col_of(c).rlike(r"(?U)\S"), F.lit(True))
