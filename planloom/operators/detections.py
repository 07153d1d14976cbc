"""Detections: counting without repeats, boxes, thresholds and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts over which the rows of one document are spread before its counts are put together.
SALTS = 32


def distinct_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without exact repeats over ``columns``; the shuffle is on all of them, so no document is hot."""
    return rows.select(*columns).distinct()


def counts_by(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Row counts by ``keys``; partial sums are made before the shuffle, so a hot key sends one row a task."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def clamp_box(box: Column, width: int, height: int) -> Column:
    """A box cut to the image, its corners as whole numbers towards zero."""
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(float(most)))).cast("int")
    return F.struct(cut(box["x1"], width).alias("x1"), cut(box["y1"], height).alias("y1"), cut(box["x2"], width).alias("x2"), cut(box["y2"], height).alias("y2"))


def best_of(rows: DataFrame, keys: list[str], score: str, columns: list[str]) -> DataFrame:
    """The row of highest score of each group, ties to the smallest of ``columns``; null scores never win over others."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.col(score).isNotNull(), F.col(score))).alias("_t")) if not columns else rows.groupBy(*keys).agg(
        F.min(F.struct(F.col(score).isNull().alias("_0"), (-F.col(score)).alias("_1"), *columns)).alias("_t")
    )
    return top.select(*keys, *[F.col(f"_t.{c}").alias(c) for c in columns], (-F.col("_t._1")).alias(score))


def softmax(logits: Column) -> Column:
    """Stable softmax of an array; null for null, empty for empty."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Position (from 0) of the largest value, the first of equal ones; null for empty or null."""
    return F.when(F.size(values) > 0, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def looked_up(counts: DataFrame, rates: DataFrame, on: str, column: str, fallback: Column, flag: str) -> DataFrame:
    """``counts`` with ``column`` from ``rates``, else ``fallback``; ``flag`` tells the rows without an entry. The optimiser broadcasts ``rates`` if its size allows."""
    entry = rates.select(on, F.col(column).alias("_v")).withColumn("_hit", F.lit(True))
    return counts.join(entry, on, "left").select(*[c for c in counts.columns if c != column], F.coalesce("_v", fallback).alias(column), F.col("_hit").isNull().alias(flag))
