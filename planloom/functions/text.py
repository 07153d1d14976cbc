"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a line, as Unicode text processing counts them.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def blank_to_null(x: Column) -> Column:
    """Null for null, empty and white-space strings, else the trimmed string."""
    trimmed = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def clean_line(x: Column) -> Column:
    """White space of any kind as single spaces, none outside, no NUL."""
    return F.trim(F.regexp_replace(F.replace(x, F.lit("\u0000"), F.lit("")), r"(?U)\s+", " "))


def fingerprint(x: Column) -> Column:
    """Upper-case letters A-Z and digits only."""
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def phone_digits(x: Column) -> Column:
    """Digits without a leading 1 of eleven; null below seven digits."""
    digits = F.regexp_replace(x, r"\D+", "")
    local = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(local) >= 7, local)


def format_phone(x: Column) -> Column:
    """``(ddd) ddd-dddd`` for ten digits, else the trimmed text."""
    d = F.regexp_replace(x, r"\D+", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))).otherwise(F.trim(x))


def title_case(x: Column) -> Column:
    """Upper case after every character that isn't a letter, lower case otherwise."""
    chars = F.split(F.lower(x), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def prettify(x: Column) -> Column:
    """``snake_case`` as words in title case."""
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def sentence_case(x: Column) -> Column:
    """An upper-case text of more than 20 characters with only its first letter in capitals."""
    shouted = (F.length(x) > 20) & (F.upper(x) == x) & (F.lower(x) != x)
    return F.when(shouted, F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))).otherwise(x)


def truncate(x: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))).otherwise(x)


def escape_markup(x: Column) -> Column:
    """``& < >`` as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x


def label_key(x: Column) -> Column:
    """A typed label for comparison: lower case, no blanks, colons, dots, dashes or underscores outside."""
    return F.regexp_replace(F.lower(x), r"^[ :.\-_]+|[ :.\-_]+$", "")


def words_set(x: Column) -> Column:
    """Distinct lower-case words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")))


def stem_name(path: Column, suffix: str) -> Column:
    """File name without its folder and last extension, with ``suffix``."""
    base = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(base, F.lit(suffix))


def letter_ratio(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}]", "")) / F.greatest(F.length(x), F.lit(1))
