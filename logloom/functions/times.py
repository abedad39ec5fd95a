"""Reading the accepted time layouts with one cast.

Spark's cast to a timestamp accepts one-digit fields, drops an offset (the wall
clock stays) and never throws. Each layout is rewritten to what the cast reads,
in one chain that mentions the text once, and what does not then look like an
accepted time is cut to empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import filled, null_words, strip

_CLOCK = r"(\d{1,2}:\d{1,2}:\d{1,2})"
_DASHED = rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}})(?:\s+|T){_CLOCK}(\.\d{{1,6}})?(?:[+-]\d{{2}}:?\d{{2}}(?::?\d{{2}})?)?$"
_SLASHED = rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})\s+{_CLOCK}$"
# read as month first only when the second number cannot be a month
_MONTH_FIRST = rf"^(\d{{1,2}})/(1[3-9]|2\d|3[01])/(\d{{4}})\s+{_CLOCK}$"
_DAY_FIRST = rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2(\d{{4}})\s+{_CLOCK}$"
_DATE_DAY_FIRST = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_REWRITTEN = r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?"
_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
_ISO_DATE = r"\d{4}-\d{2}-\d{2}"
# ISO 8601: with or without dashes and colons, any one character before the time, an offset that is dropped
_DAY = r"^(\d{4})(-?)(\d{2})\2(\d{2})"
_OFFSET = r"(?:[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d{1,6})?)?)?)?$"
_ISO_FORMS = [
    (rf"{_DAY}[^\d](\d{{2}}){_OFFSET}", "$1-$3-$4 $5:00:00"),
    (rf"{_DAY}[^\d](\d{{2}}):?(\d{{2}}){_OFFSET}", "$1-$3-$4 $5:$6:00"),
    (rf"{_DAY}[^\d](\d{{2}})(:?)(\d{{2}})\6(\d{{2}}){_OFFSET}", "$1-$3-$4 $5:$7:$8"),
    (rf"{_DAY}[^\d](\d{{2}})(:?)(\d{{2}})\6(\d{{2}})[.,](\d{{1,6}})\d*{_OFFSET}", "$1-$3-$4 $5:$7:$8.$9"),
]
_WEEK = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(?=$|[^\d])"
#: Most times look like this and need no rewriting.
_PLAIN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"


def _without_zone(value: Column) -> Column:
    return strip(F.replace(value, F.lit("Z"), F.lit("")))


def _from_week(text: Column) -> Column:
    """An ISO week date as a calendar date; what follows it stays. Weeks a year doesn't have are not read."""
    part = lambda k: F.nullif(F.regexp_extract(text, _WEEK, k), F.lit("")).cast("int")
    fourth = F.make_date(part(1), F.lit(1), F.lit(4))
    day = F.date_add(fourth, 7 * (part(3) - 1) + F.coalesce(part(4), F.lit(1)) - 1 - F.weekday(fourth))
    whole = F.concat(F.date_format(day, "yyyy-MM-dd"), F.regexp_replace(text, _WEEK, ""))
    return F.when(text.rlike(_WEEK), F.when(F.weekofyear(day) == part(3), whole).otherwise("")).otherwise(text)


def _read(text: Column, rewrites: list[tuple[str, str]], accepted: tuple[str, ...]) -> Column:
    """Times in the common layout are cast as they are; only others go through the chain."""
    plain, other = text.rlike(_PLAIN), _from_week(text)
    for pattern, form in rewrites:
        other = F.regexp_replace(other, pattern, form)
    fitted = F.regexp_extract(other, f"^(?:{'|'.join(accepted)})$", 0)
    return F.when(plain, text.try_cast("timestamp_ntz")).otherwise(fitted.try_cast("timestamp_ntz"))


_LOG_FORMS = [
    (_DASHED, "$1 $2$3"), (_SLASHED, "$1-$2-$3 $4"), (_DAY_FIRST, "$4-$3-$1 $5"), (_COMPACT, "$1-$2-$3"), *_ISO_FORMS,
]
_LOOSE_FORMS = [(_MONTH_FIRST, "$3-$1-$2 $4"), (_DATE_DAY_FIRST, "$3-$2-$1"), *_LOG_FORMS]


def parse_time(value: Column) -> Column:
    """Accepted log time as a wall-clock timestamp, null when unreadable."""
    return _read(_without_zone(strip(value)), _LOG_FORMS, (_REWRITTEN, _ISO_DATE))


def iso_utc(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalize_time(value: Column) -> Column:
    """Time text as ``yyyy-MM-ddTHH:mm:ssZ``; unreadable text comes back unchanged."""
    read = _read(_without_zone(strip(value)), _LOOSE_FORMS, (_REWRITTEN, _ISO_DATE, _DATE))
    return F.coalesce(iso_utc(read), null_words(filled(value), ("nan", "nat", "none", "null", "n/a")))
