"""Calendar days read by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """``YYYY-MM-DD`` of a day that exists, else null."""
    day_ = F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.date_format(day_, "yyyy-MM-dd"))


def normal_day(raw: Column) -> Column:
    """``YYYY-MM-DD`` of a typed day, else the trimmed text.

    Read are year-month-day, day/month/year before month/day/year where the year has four
    digits, month first where it has two, day.month.year, and months by name or its first
    three letters.
    """
    t = F.trim(raw)
    group = lambda pattern, n: F.nullif(F.regexp_extract(t, pattern, n), F.lit(""))
    ymd = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    four = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$"
    two = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$"
    dots = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    day_first, month_first = r"^(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})$", r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$"
    names = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS, 1) for key in {m, m[:3]} for x in (key, f"{i:02d}")])
    month = lambda pattern, n: F.try_element_at(names, F.lower(group(pattern, n)))
    short = group(two, 4)
    century = F.when(short.cast("int") >= 69, F.concat(F.lit("19"), short)).otherwise(F.concat(F.lit("20"), short))
    return F.coalesce(
        _iso(group(ymd, 1), group(ymd, 2), group(ymd, 3)),
        _iso(group(four, 4), group(four, 3), group(four, 1)),
        _iso(group(four, 4), group(four, 1), group(four, 3)),
        _iso(F.when(short.isNotNull(), century), group(two, 1), group(two, 3)),
        _iso(group(dots, 3), group(dots, 2), group(dots, 1)),
        _iso(group(day_first, 3), month(day_first, 2), group(day_first, 1)),
        _iso(group(month_first, 3), month(month_first, 1), group(month_first, 2)),
        t,
    )
