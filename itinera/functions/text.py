"""Text predicates and keys shared by the operators; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_blank(c: Column) -> Column:
    """True where the text has a character other than white space; null is false."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False))


def squeeze(c: Column) -> Column:
    """The text without white space, of any script, at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def alnum_key(c: Column) -> Column:
    """Letters and digits of the text, in order and in upper case; null stays null."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def letters_digits_key(c: Column) -> Column:
    """Letters of the text in upper case, a bar, then its digits: ``0687 TS`` and ``TS0687`` agree."""
    letters = F.upper(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.concat(letters, F.lit("|"), F.regexp_replace(c, r"[^\p{N}]", ""))
