"""String similarity as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_of(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    for c in b:
        met = free & at.get(c, 0)
        free = ((free + met) | (free - met)) & full
    return len(a) - free.bit_count()


def lcs_similarity(a: Column, b: Column) -> Column:
    """2 * LCS / (|a| + |b|), from 0 to 1, in Arrow batches; null if either is null, 1 for two empty strings. For pairs that cheaper bounds have left."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 1.0 if p == q else 2.0 * lcs_of(p, q) / (len(p) + len(q)) for p, q in zip(x, y)], dtype="float64")

    return similarity(a, b)


def letter_mask(word: Column) -> Column:
    """Bit mask of the letters a to z a word holds once and twice.

    Two words of which one has ``n`` letters outside their longest common subsequence
    and the other ``m`` differ in at most ``n + m`` bits, so ``differing_letters`` is a
    lower bound of what the subsequence leaves out.
    """
    at = lambda c: F.ascii(c) - 97
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    letters = F.filter(F.split(word, ""), lambda c: c.rlike("^[a-z]$"))
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(F.when(m.bitwiseAND(bit(at(c))) == 0, bit(at(c))).otherwise(bit(at(c) + 26))))


def differing_letters(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; null if either is null. For short strings: the table is built row by row."""
    other = F.filter(F.split(b, ""), lambda c: c != "")
    rows = F.aggregate(
        F.filter(F.split(a, ""), lambda c: c != ""),
        F.array_repeat(F.lit(0), F.length(b) + 1),
        lambda row, c: F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda new, j: F.array_append(new, F.when(F.get(other, j - 1) == c, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(new, j - 1)))),
        ),
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((a == "") | (b == ""), 0).otherwise(F.element_at(rows, -1))


def lcs_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (|a| + |b|), from 0 to 1; two empty strings are alike."""
    total = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)


def edits_within(least: float, total: Column) -> Column:
    """Edits that words of this total length may need if their ``lcs_ratio`` reaches ``least``; never one too few by floating point."""
    return F.floor((1 - least) * total + 1e-9)


def ratio(a: Column, b: Column) -> Column:
    """Similarity 0 to 100 of two strings: the share of letters in their longest common subsequence."""
    return 100.0 * lcs_ratio(a, b)


def ratio_from(a: Column, b: Column, least: float) -> Column:
    """``ratio`` where it reaches ``least``, else 0.

    A ratio r leaves (1 - r/100) of both lengths unmatched, and no alignment needs more
    edits than that: the built-in edit distance rules most pairs out before the costly ratio.
    """
    return F.when(a == b, 100.0).when(F.levenshtein(a, b) <= F.floor((100 - least) / 100 * (F.length(a) + F.length(b))), F.when(ratio(a, b) >= least, ratio(a, b)).otherwise(0.0)).otherwise(0.0)


def token_set_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Similarity 0 to 100 of the word sets: 100 if one holds the other, else the best of common words and each side's rest; 0 below ``least``."""
    wa, wb = (F.array_sort(F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != ""))) for x in (a, b))
    common, only_a, only_b = F.array_join(F.array_intersect(wa, wb), " "), F.array_join(F.array_except(wa, wb), " "), F.array_join(F.array_except(wb, wa), " ")
    left, right = F.trim(F.concat_ws(" ", common, only_a)), F.trim(F.concat_ws(" ", common, only_b))
    inside = (common != "") & ((only_a == "") | (only_b == ""))
    # The common words begin each side, so their ratio to it follows from the lengths.
    part = lambda whole: 200.0 * F.length(common) / (F.length(common) + F.length(whole))
    best = F.greatest(F.when(common != "", F.greatest(part(left), part(right))).otherwise(0.0), ratio_from(left, right, least))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).when(inside, 100.0).otherwise(F.when(best >= least, best).otherwise(0.0))
