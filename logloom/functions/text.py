"""Text helpers shared by validation and cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def filled(value: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def null_words(value: Column, words: Iterable[str]) -> Column:
    """Null for the given placeholder words in any case."""
    return F.when(~F.lower(value).isin(*words), value)


def first_filled(df: DataFrame, names: Iterable[str]) -> Column:
    """First non-empty column among those of ``names`` that ``df`` has."""
    present = [filled(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def without_controls(value: Column) -> Column:
    return F.regexp_replace(value, CONTROL_CHARACTERS, "")


def capitalized(value: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 2147483647)))


def iso(value: Column) -> Column:
    """ISO text of a time; the fraction appears only when it is not zero."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))


def micros(value: Column) -> Column:
    return F.unix_micros(value.cast("timestamp"))
