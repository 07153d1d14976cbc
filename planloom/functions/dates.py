"""Reading of typed dates and times: one text and its home zone to one day or instant."""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names and their usual short forms in the three languages of the documents, without accents.
_MONTH_WORDS = (
    "january jan janvier janv enero ene",
    "february feb fevrier fevr fev febrero",
    "march mar mars marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juin junio",
    "july jul juillet juil julio",
    "august aug aout agosto ago",
    "september sep sept septembre septiembre setiembre",
    "october oct octobre octubre",
    "november nov novembre noviembre",
    "december dec decembre diciembre dic",
)
MONTHS = {w: n for n, words in enumerate(_MONTH_WORDS, 1) for w in words.split()}

# Written zone names: a number of hours is a fixed offset, a string a zone with clock changes.
ZONE_NAMES = {
    "z": 0, "utc": 0, "gmt": 0,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
    "akst": -9, "akdt": -8, "hst": -10, "hdt": -9,
    "et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles",
    "akt": "America/Anchorage", "ht": "Pacific/Honolulu",
    "eastern": "America/New_York", "central": "America/Chicago", "mountain": "America/Denver",
    "pacific": "America/Los_Angeles", "hawaii": "Pacific/Honolulu", "arizona": "America/Phoenix",
    "cet": 1, "cest": 2, "bst": 1, "ist": 5.5,
}

_HALF = r"(?P<half>a\.?\s?m\b\.?|p\.?\s?m\b\.?|noon\b|midnight\b)"
_CLOCK = re.compile(
    rf"(?<![\d:.])(?P<h>\d{{1,2}})(?::(?P<m>\d{{2}})(?::(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?(?![\d:])(?:\s*{_HALF})?"
    rf"|\s*h\s*(?P<m2>\d{{2}})\b|\s*{_HALF.replace('half', 'half2')})"
)
_WORD_CLOCK = re.compile(r"\b(noon|midnight)\b")
_OFFSET = re.compile(r"\s*(?:(?:utc|gmt)\s*)?(?P<sign>[+-])\s?(?P<h>\d{1,2}):?(?P<m>\d{2})(?!\d)|\s*(?:utc|gmt)\s*(?P<sign2>[+-])\s?(?P<h2>\d{1,2})(?![\d:])")
_NAMED = re.compile(r"\s*\(?(?P<name>[a-z]{1,8})\b(?:\s+time\b)?\)?")
_AREA = re.compile(r"[\[(]?\s*\b(?P<area>(?:america|pacific|us|europe|asia|etc|africa|atlantic|australia|indian)/[a-z_]+(?:/[a-z_]+)?)\s*[\])]?")
_COMPACT = re.compile(r"(?<!\d)(?P<d>\d{8})\s?t?\s?(?P<h>\d{2})(?P<m>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,9}))?(?P<z>z|[+-]\d{2}:?\d{2})?(?!\d)")
_MONTH = r"(?P<mon>[a-z]{3,10})"
_DATE_FORMS = (
    ("ymd", re.compile(r"(?<!\d)(?P<a>\d{4})(?P<sep>[-/.]|\s)(?P<b>\d{1,2})(?P=sep)(?P<c>\d{1,2})(?!\d)")),
    ("any4", re.compile(r"(?<!\d)(?P<a>\d{1,2})(?P<sep>[-/.]|\s)(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4})(?!\d)")),
    ("mdy2", re.compile(r"(?<!\d)'?(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)'?(?P<c>\d{2})(?!\d)")),
    ("dmon", re.compile(rf"(?<!\d)(?P<a>\d{{1,2}})(?:st|nd|rd|th|er|o)?[\s\-./]*(?:of\s+|de\s+|du\s+)?{_MONTH}\b[\s\-./,]*(?:de[l]?\s+)?(?P<c>\d{{4}}|'?\d{{2}})(?!\d)")),
    ("mond", re.compile(rf"\b{_MONTH}\b[\s\-./]*(?P<a>\d{{1,2}})(?:st|nd|rd|th)?(?!\d)[\s\-./,]*(?P<c>\d{{4}}|'\d{{2}})(?!\d)")),
    ("ymond", re.compile(rf"(?<!\d)(?P<c>\d{{4}})[\s\-./,]*{_MONTH}\b[\s\-./]*(?P<a>\d{{1,2}})(?:st|nd|rd|th)?(?!\d)")),
    ("packed", re.compile(r"(?<!\d)(?P<a>(?:19|20)\d{2})(?P<b>\d{2})(?P<c>\d{2})(?!\d)")),
)
_EPOCH = re.compile(r"(\d{10})(\d{3})?(\d{3})?(?:\.(\d{1,6}))?")
_EPOCH_YEARS = (1990, 2100)


def _day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _full_year(text: str) -> int:
    n = int(text.strip("'"))
    return n if len(text.strip("'")) == 4 else n + (1900 if n > 68 else 2000)


def _read_day(text: str) -> tuple[date, str] | None:
    """The only date written in the text and what is left of the text; None for none or for a day that doesn't exist."""
    for form, pattern in _DATE_FORMS:
        for m in pattern.finditer(text):
            if form in ("ymd", "packed"):
                day = _day(int(m["a"]), int(m["b"]), int(m["c"]))
            elif form == "any4":
                day = _day(int(m["c"]), int(m["b"]), int(m["a"])) or _day(int(m["c"]), int(m["a"]), int(m["b"]))
            elif form == "mdy2":
                day = _day(_full_year(m["c"]), int(m["a"]), int(m["b"]))
            else:
                month = MONTHS.get(m["mon"])
                if month is None:
                    continue
                day = _day(_full_year(m["c"]), month, int(m["a"]))
            return (day, text[: m.start()] + " " + text[m.end() :]) if day else None
    return None


def _zone(name: str) -> timezone | ZoneInfo:
    found = ZONE_NAMES[name]
    return ZoneInfo(found) if isinstance(found, str) else timezone(timedelta(hours=found))


@lru_cache(maxsize=64)
def _area(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo("/".join("_".join(w.capitalize() for w in p.split("_")) if p not in ("us",) else "US" for p in name.split("/")))
    except Exception:
        return None


def _offset(sign: str, hours: str, minutes: str | None) -> timezone | None:
    shift = timedelta(hours=int(hours), minutes=int(minutes or 0))
    return timezone(-shift if sign == "-" else shift) if shift <= timedelta(hours=14) else None


def _micros(fraction: str | None) -> int:
    return int((fraction or "0")[:6].ljust(6, "0"))


def _instant(day: date, h: int, mi: int, s: int, us: int, zone) -> str | None:
    extra = timedelta(0)
    if h == 24 and mi == s == us == 0:
        h, extra = 0, timedelta(days=1)
    if h > 23 or mi > 59 or s > 59 or zone is None:
        return None
    try:
        at = (datetime(day.year, day.month, day.day, h, mi, s, us) + extra).replace(tzinfo=zone).astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond:06d}Z" if at.year >= 1000 else None


def _read_epoch(text: str) -> str | None:
    m = _EPOCH.fullmatch(text)
    if not m:
        return None
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=int(m[1]), microseconds=int(((m[2] or "") + (m[3] or "") + (m[4] or ""))[:6].ljust(6, "0")))
    ok = _EPOCH_YEARS[0] <= at.year <= _EPOCH_YEARS[1]
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond:06d}Z" if ok else None


def read_moment(raw: str | None, home_zone: str | None) -> str | None:
    """``YYYY-MM-DD`` when only a day is stated, the UTC instant when a time is, else None.

    A written zone or offset wins over ``home_zone``; a local time with neither fixes
    no instant and gives None. A local time that occurs twice is the first of the two;
    one that a clock change skips is read with the offset before the change.
    Texts with more than one date, with a quarter, month or year only, and days that
    don't exist give None.
    """
    if raw is None:
        return None
    text = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c))
    text = re.sub(r"\s+", " ", text.replace("–", "-").replace("−", "-").replace("’", "'")).strip().lower()
    if not any(c.isdigit() for c in text):
        return None
    if bare := re.fullmatch(r"(?:[a-z ]*[: ]\s*)?(\d{10,16}(?:\.\d+)?)", text):
        if found := _read_epoch(bare[1]):
            return found
    zone, home = None, (_area(home_zone.lower()) or None) if home_zone else None
    if m := _AREA.search(text):
        zone = _area(m["area"])
        text = text[: m.start()] + " " + text[m.end() :]
    if m := _COMPACT.search(text):
        y = m["d"]
        day = _day(int(y[:4]), int(y[4:6]), int(y[6:]))
        rest = text[: m.start()] + " " + text[m.end() :]
        if day and not re.search(r"\d", rest):
            if m["z"]:
                zone = timezone.utc if m["z"] == "z" else _offset(m["z"][0], m["z"][1:3], m["z"][-2:])
            elif (n := _NAMED.match(rest[m.start() :])) and n["name"] in ZONE_NAMES:
                zone = _zone(n["name"])
            return _instant(day, int(m["h"]), int(m["m"]), int(m["s"] or 0), _micros(m["f"]), zone or home)
    clock = None
    timed = re.sub(r"(?<=\d)t(?=\d\d:)", " ", text)
    m = _CLOCK.search(timed)
    if m:
        half = (m["half"] or m["half2"] or "").replace(".", "").replace(" ", "")
        h, mi = int(m["h"]), int(m["m"] or m["m2"] or 0)
        if half in ("am", "midnight"):
            h = 0 if h == 12 else h
        elif half == "pm":
            h = h + 12 if h < 12 else h
        clock = (h, mi, int(m["s"] or 0), _micros(m["f"]))
        end = m.end()
        if o := _OFFSET.match(timed, end):
            zone = _offset(o["sign"] or o["sign2"], o["h"] or o["h2"], o["m"])
            end = o.end()
        elif (n := _NAMED.match(timed, end)) and n["name"] in ZONE_NAMES:
            zone = _zone(n["name"])
            end = n.end()
        timed = timed[: m.start()] + " ; " + timed[end:]
    elif m := _WORD_CLOCK.search(timed):
        clock = (12 if m[1] == "noon" else 0, 0, 0, 0)
        timed = timed[: m.start()] + " ; " + timed[m.end() :]
    found = _read_day(timed)
    if found is None:
        return None
    day, rest = found
    if re.search(r"\d", rest):
        return None
    return _instant(day, *clock, zone or home) if clock else day.isoformat()
