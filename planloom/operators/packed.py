"""Several values typed into one field: one row for each value, its position kept.

The text is cut at true quote marks first. Odd pieces are literals; even pieces are
cut at delimiters. Array functions put the values back together with their ordinals,
all as Catalyst expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use characters that stand for a doubled quote, a true quote and a cut.
DOUBLED, QUOTE, CUT = "", "", ""


@dataclass(frozen=True)
class Packing:
    """How the values of one field are set apart.

    strong: regex of a delimiter that always cuts. weak: regex of a delimiter that
    cuts only where ``start``, the beginning of a value, follows. No look-around is
    used, so other engines can run the same patterns.
    """

    strong: str
    weak: str | None = None
    start: str | None = None
    #: A comma that stands next to a quoted value cuts its whole unquoted piece: a value that held one would be quoted too.
    edge_comma: bool = False


#: Drawing sheets: a code or a running number opens each sheet, so that titles may hold , ; / & and -.
SHEETS = Packing(strong=r"[\t\r\n|•]+", weak=r"\s*(?:[;,/&]|\band\b)\s*", start=r"SHT\.?\s*[0-9]+\s*-|[A-Z]{1,3}-?[0-9]{2,4}(?:\.[0-9]+)?\s+[A-Z0-9]")
#: Postal addresses: their own commas never cut; slash, ampersand and "and" do between spaces.
ADDRESSES = Packing(strong=r"[\t\r\n|•;]+|\s+(?:/|&|[Aa][Nn][Dd])(?:\s+|$)", edge_comma=True)
#: What may stand before and after a quoted value.
_EDGE = r"[;,|/•&\t\r\n]"
_OUTER = r"^(?:[\s;,|/•&]|-\s)+|[\s;,|/•&]+$"


def split_values(entry: Column, how: Packing) -> Column:
    """Array of the values of one entry, in order, without empty ones; null for null.

    A quote is a true one only where it opens after a delimiter (or the start) and
    closes before one (or the end); any other, such as an inch mark, is text.
    """
    marked = F.regexp_replace(F.replace(entry, F.lit('""'), F.lit(DOUBLED)), rf'(^\s*|{_EDGE}\s*|\s[Aa][Nn][Dd]\s+)"([^"]*)"(\s*$|\s*{_EDGE}|\s+[Aa][Nn][Dd]\s)', f"$1{QUOTE}$2{QUOTE}$3")
    # The closing context of one quoted value is the opening context of the next, so a second pass takes those between.
    marked = F.regexp_replace(marked, rf'(^\s*|{_EDGE}\s*|\s[Aa][Nn][Dd]\s+)"([^"]*)"(\s*$|\s*{_EDGE}|\s+[Aa][Nn][Dd]\s)', f"$1{QUOTE}$2{QUOTE}$3")
    pieces = F.split(marked, QUOTE)

    def cut(piece: Column) -> Column:
        at_weak = piece if how.weak is None else F.regexp_replace(piece, f"(?:{how.weak})+({how.start})", f"{CUT}$1")
        if how.edge_comma:
            at_weak = F.when(at_weak.rlike(r"^\s*,|,\s*$"), F.replace(at_weak, F.lit(","), F.lit(CUT))).otherwise(at_weak)
        return F.transform(F.split(F.regexp_replace(at_weak, how.strong, CUT), CUT), lambda t: F.regexp_replace(t, _OUTER, ""))

    parts = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.array(F.trim(p))).otherwise(cut(p)))
    whole = F.transform(F.flatten(parts), lambda t: F.regexp_replace(F.replace(t, F.lit(DOUBLED), F.lit('"')), r"^\s+|\s+$", ""))
    return F.filter(whole, lambda t: (F.length(t) > 0) & ~t.rlike(r"^(?:[Aa][Nn][Dd]|[\s;,|/•&\"]*)$"))


def unpack(rows: DataFrame, keys: list[str], entries: str, how: Packing, least: int = 1) -> DataFrame:
    """One row for each value: ``keys``, entry_no, value_no, value_text, both counted from 1.

    entries: an array<string> column. Null and empty arrays and null or blank entries
    give no rows; repeated entries and values keep their own positions. ``least``
    keeps only entries with that many values. Other columns don't matter, even if
    they are called like the output's. Each entry is handled alone: no shuffle.
    """
    named = rows.select(*[F.col(k) for k in keys], F.posexplode(F.col(entries)).alias("_at", "_entry"))
    values = named.select(*keys, (F.col("_at") + 1).alias("entry_no"), split_values(F.col("_entry"), how).alias("_values")).where(F.size("_values") >= least)
    return values.select(*keys, "entry_no", F.posexplode("_values").alias("_no", "value_text")).select(*keys, "entry_no", (F.col("_no") + 1).alias("value_no"), "value_text")
