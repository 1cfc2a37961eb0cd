"""Column expressions over texts as bytes.

Texts are bytes throughout: a string counts as its UTF-8 form, an n-gram may split a character, and
white space is the six ASCII bytes that C calls so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bytes that count as white space.
WHITESPACE = b" \t\n\x0b\x0c\r"


def utf8(text: Column) -> Column:
    """The bytes of a string; of null, none."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def as_latin1(data: Column) -> Column:
    """A string with one character for each byte, for regular expressions over bytes."""
    return F.decode(data, "ISO-8859-1")


def words(data: Column) -> Column:
    """What white space parts, as an array of byte strings; none is empty."""
    parts = F.filter(F.split(as_latin1(data), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.encode(w, "ISO-8859-1"))


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that follows from the key and the seed alone; the same in any engine that has MD5."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def or_zero(value: Column) -> Column:
    """Not a number and null count as zero."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
