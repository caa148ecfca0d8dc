"""Text and time scalars used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Elapsed 'HH:MM:SS' as seconds; anything that has not exactly three whole-number parts gives null."""
    x = F.regexp_extract(ts, r"^\s*(\d{1,4}):(\d{1,2}):(\d{1,2})\s*$", 0)
    part = F.split(F.btrim(x), ":")
    return F.when(x != "", F.get(part, F.lit(0)).try_cast("int") * 3600 + F.get(part, F.lit(1)).try_cast("int") * 60 + F.get(part, F.lit(2)).try_cast("int"))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's different words that b has too; 0 where either has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def words(text: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters and digits of any script, of at least so many characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}\p{{N}}]{{{least},}})"), F.lit(1))


#: Spaces that \\s of Java's patterns does not match.
ODD_SPACES = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"


def plain_spaces(text: Column) -> Column:
    """The text with a plain space for every odd one; lengths and places stay as they are."""
    return F.when(text.rlike("[\\u00a0\\u2002\\u2003\\u2007\\u2009\\u202f\\u3000]"), F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))).otherwise(text)
