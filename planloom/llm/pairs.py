"""Pairs of rows of one block, and of records of one class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one class that one task pairs; a larger class is cut into slices paired with each other.
SLICE = 2000
#: Rows of a block that one task compares with as many; a larger block is cut into slices, and every slice is paired with every other.
BLOCK = 500


def in_slices(keyed: DataFrame, key: str, ident: str) -> DataFrame:
    """Rows of blocks of two and more with ``_slices``, ``_slice``: no task holds a common block, and none of its pairs is left out."""
    size = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    return keyed.join(size, key).withColumn("_slices", F.ceil(F.col("_size") / max(BLOCK, 1)).cast("int")).withColumn("_slice", F.pmod(F.xxhash64(ident), F.col("_slices")).cast("int")).drop("_size")


def block_pairs(blocks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each unordered pair of a block's rows once, also across slices: ``a_`` and ``b_`` columns; ``columns[0]`` tells rows apart."""
    rows = blocks.select(key, "_slice", "_slices", *columns)
    a = rows.select(key, F.col("_slice").alias("_i"), F.explode(F.sequence(F.col("_slice"), F.col("_slices") - 1)).alias("_j"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.select(key, F.explode(F.sequence(F.lit(0), F.col("_slice"))).alias("_i"), F.col("_slice").alias("_j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, [key, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col(f"a_{columns[0]}") < F.col(f"b_{columns[0]}"))).drop(key, "_i", "_j")


def block_matches(blocks: DataFrame, key: str, columns: list[str], chosen: Column) -> DataFrame:
    """As ``block_pairs``, of the pairs with at least one ``chosen`` row only: no task meets the others."""
    rows = blocks.select(key, "_slice", "_slices", chosen.alias("_chosen"), *columns)
    every = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    a = rows.select(key, F.col("_slice").alias("_i"), every.alias("_j"), F.col("_chosen").alias("_too"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.where("_chosen").select(key, every.alias("_i"), F.col("_slice").alias("_j"), *[F.col(c).alias(f"b_{c}") for c in columns])
    one, other = F.col(f"a_{columns[0]}"), F.col(f"b_{columns[0]}")
    return a.join(b, [key, "_i", "_j"]).where((one != other) & (~F.col("_too") | (one < other))).drop(key, "_i", "_j", "_too")


def class_pairs(members: DataFrame, of: str) -> DataFrame:
    """(rec_a, rec_b), smaller key first, of records in one class whose raw strings differ; distinct.

    members: (key, raw, <of>). A large class is cut into slices by a hash of the key and
    every pair of slices is a task's work, so no task holds a whole large class.
    """
    sizes = members.groupBy(of).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    rows = members.join(sizes, of).withColumn("_slices", F.ceil(F.col("_n") / SLICE).cast("int")).withColumn("_slice", F.pmod(F.xxhash64("key"), F.col("_slices")).cast("int"))
    # Each two slices meet once: the row of the lower slice goes to all from its own on, that of the higher to all up to its own.
    left = rows.select(of, "key", "raw", F.col("_slice").alias("_i"), F.explode(F.sequence(F.col("_slice"), F.col("_slices") - 1)).alias("_j"))
    right = rows.select(of, F.col("key").alias("key_b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("_slice"))).alias("_i"), F.col("_slice").alias("_j"))
    pairs = left.join(right, [of, "_i", "_j"]).where((F.col("raw") != F.col("raw_b")) & ((F.col("_i") < F.col("_j")) | (F.col("key") < F.col("key_b"))))
    return pairs.select(F.least("key", "key_b").alias("rec_a"), F.greatest("key", "key_b").alias("rec_b"))
