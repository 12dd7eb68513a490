"""Text scalars as Column expressions (all JVM-side)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that counts as blank at either end of a value: Unicode separators, controls, format characters.
EDGE = r"^[\s\p{Z}\p{Cc}\p{Cf}]+|[\s\p{Z}\p{Cc}\p{Cf}]+$"


def trimmed(c: Column) -> Column:
    """Without white space, controls and zero-width characters at the ends; null stays null."""
    return F.regexp_replace(c, EDGE, "")


def latin_fold_tables() -> tuple[str, str]:
    """Accented Latin letters up to U+024F and their base letters, from the Unicode decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha() and base != chr(code):
            pairs.append((chr(code), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = latin_fold_tables()


def unaccented(c: Column) -> Column:
    """Lower case, Latin letters without their accents (composed or as combining marks U+0300 to U+036F)."""
    return F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"[̀-ͯ]", "")


def is_missing(c: Column, kind: str) -> Column:
    """True for null, for the empty string and for empty collections. ``kind``: string, array or map."""
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0)


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
