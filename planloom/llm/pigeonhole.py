"""Edit-distance join against a reference list by partitioning, in SQL expressions only.

A reference string is cut into k+1 segments. If a value is within k edits of it, at
least one segment occurs unchanged in the value, moved by at most k places. So an
equality join on (reference length, segment number, segment text) finds every
candidate, and the built-in ``levenshtein`` verifies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed_edits(length: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    """Edits allowed for a reference string of this length; steps: (from length, edits), ascending."""
    k = F.lit(0)
    for least, edits in steps:
        k = F.when(length >= least, F.lit(edits)).otherwise(k)
    return k


def _segment(text: Column, length: Column, k: Column, no: Column, shift: Column | int = 0) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``no`` (from 0) of a string of ``length``; the first segments are the short ones."""
    base = F.floor(length / (k + 1)).cast("int")
    longer = (length % (k + 1)).cast("int")  # that many last segments have one more
    short = k + 1 - longer
    start = no * base + F.greatest(no - short, F.lit(0)) + 1 + shift
    size = base + F.when(no >= short, 1).otherwise(0)
    return start, size


def pigeonhole_candidates(values: DataFrame, refs: DataFrame, value: str, ref: str, steps: tuple[tuple[int, int], ...], same: list[str] | None = None) -> DataFrame:
    """Pairs (all columns of values and of refs, distance) within the edits allowed for the reference.

    ``values[value]`` and ``refs[ref]`` are strings; ``same`` names columns both sides
    have that must be equal too. Give distinct values: the work is done once for each
    row. Null strings pair with nothing; references shorter than their number of
    segments can't be cut and are compared by equality, so allow them no edits.
    """
    same = same or []
    kmax = max([0, *(e for _, e in steps)])
    r = refs.where(F.col(ref).isNotNull()).withColumn("_len", F.length(ref)).withColumn("_k", allowed_edits(F.col("_len"), steps))
    r = r.withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    start, size = _segment(F.col(ref), F.col("_len"), F.col("_k"), F.col("_no"))
    r = r.withColumn("_seg", F.substring(F.col(ref), start, size))
    v = values.where(F.col(value).isNotNull())
    n = F.length(value)
    v = v.withColumn("_len", F.explode(F.sequence(F.greatest(n - kmax, F.lit(0)), n + kmax))).withColumn("_k", allowed_edits(F.col("_len"), steps))
    v = v.where(F.abs(F.length(value) - F.col("_len")) <= F.col("_k"))
    v = v.withColumn("_no", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    v = v.withColumn("_shift", F.explode(F.sequence(-F.col("_k"), F.col("_k"))))
    start, size = _segment(F.col(value), F.col("_len"), F.col("_k"), F.col("_no"), F.col("_shift"))
    v = v.where((start >= 1) & (start + size - 1 <= F.length(value)))
    # A segment that a value holds at two of these places only repeats a pair, and pairs are made distinct at the end, when few are left.
    v = v.withColumn("_seg", F.substring(F.col(value), start, size)).drop("_shift", "_k")
    pairs = v.join(r, [*same, "_len", "_no", "_seg"]).drop("_len", "_no", "_seg")
    distance = F.levenshtein(F.col(value), F.col(ref))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= F.col("_k")).drop("_k").distinct()
