"""Normal forms of ids, and small expression helpers every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Unicode or ASCII calls white space.
WHITE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)


#: The same as a class of a regular expression.
WHITE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE)


def stripped(col: Column | str) -> Column:
    """The string without white space of any kind at either end."""
    x = F.col(col) if isinstance(col, str) else col
    # trimming by a set of characters is slow, and most ids have nothing to trim
    return F.when(x.rlike(r"^[\p{Alnum}._-]*$"), x).otherwise(F.btrim(x, F.lit(WHITE)))


def norm_id(col: Column | str) -> Column:
    """Trimmed and upper-cased id; null stays null."""
    return F.upper(stripped(col))


def linkable_id(col: Column | str) -> Column:
    """As norm_id, but null for ids that name nothing: blank and UNK."""
    x = norm_id(col)
    return F.when(~x.isin("", "UNK"), x)


def whole_number(col: Column | str) -> Column:
    """'7', ' 007 ' and '7.0' give 7; anything that is not a whole number gives null."""
    x = stripped(col)
    digits = F.regexp_extract(x, r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
    return digits.try_cast("bigint")


def is_blank(col: Column | str) -> Column:
    """Null, empty or nothing but white space."""
    x = F.col(col) if isinstance(col, str) else col
    return ~F.coalesce(x.rlike(f"[^{WHITE_CLASS}]"), F.lit(False))
