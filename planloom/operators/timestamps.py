"""Typed dates and times brought to one unambiguous form through a dictionary of distinct texts.

Each distinct (source, text, zone) is parsed once, whatever the number of rows that
hold it; the dictionary can be kept between runs, so later runs parse new texts only.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions import dates
from planloom.functions.dates import read_moment
from planloom.operators.skew import heavy_key_join
from planloom.session import fresh_path, materialise, scratch_dir, spread

KEYS = ["source", "raw", "zone"]
ENTRY = "source string, raw string, zone string, norm_value string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        values = [read_moment(r, z or None) for r, z in zip(b["raw"], b["zone"])]
        yield b.assign(norm_value=pd.Series(values, index=b.index, dtype=object))


class MomentDictionary:
    """Distinct raw texts with their normalised values, kept as a Parquet table.

    ``update`` parses only what the table lacks and appends it; texts that fix no
    moment are kept too (null value), so they aren't parsed again. A second writer
    may append an entry twice; reading removes such repeats.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "moments")

    @classmethod
    def shared(cls, spark) -> MomentDictionary:
        """The dictionary kept in the shared folder for the present reading rules: later runs there parse new texts only; changed rules begin another."""
        rules = hashlib.sha256(inspect.getsource(dates).encode()).hexdigest()[:16]
        return cls(spark, f"{scratch_dir(spark)}/planloom/moments-kept-{rules}")

    def entries(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self.path).dropDuplicates(KEYS)

    def update(self, distinct: DataFrame) -> DataFrame:
        """Add the entries of ``distinct`` (KEYS) that are missing; returns all entries."""
        new = materialise(spread(distinct.select(*KEYS).join(self.entries(), KEYS, "left_anti"), *KEYS), "new-moment-texts")
        if not new.isEmpty():
            spread(new, *KEYS).mapInPandas(_parse, ENTRY).write.mode("append").parquet(self.path)
        return self.entries()


def normalise_moments(rows: DataFrame, source: str, raw: str, zone: str, dictionary: MomentDictionary | None = None, out: str = "norm_value", stated_only: bool = False) -> DataFrame:
    """``rows`` with column ``out``: a day, a UTC instant, or null.

    ``source``, ``raw`` and ``zone`` name string columns; ``zone`` may be null (a local
    time without a written zone then gives null). Null, empty, blank and unreadable
    texts give null; repeated rows are kept; other columns pass through, whatever their
    names. ``stated_only`` leaves out the rows without a value. The rules for the texts
    are those of ``functions.dates.read_moment``.
    """
    dictionary = dictionary or MomentDictionary(rows.sparkSession)
    keyed = materialise(rows.select(F.struct("*").alias("_row"), F.col(source).alias("source"), F.col(raw).alias("raw"), F.coalesce(F.col(zone), F.lit("")).alias("zone")), "moment-rows")
    readable = F.coalesce(F.col("source").isNotNull() & F.col("raw").rlike("[0-9]"), F.lit(False))
    counted = materialise(keyed.where(readable).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")), "moment-texts")
    entries = dictionary.update(counted).join(counted, KEYS)
    if stated_only:
        entries = entries.where(F.col("norm_value").isNotNull())
    found = heavy_key_join(keyed.where(readable), entries, KEYS, "_n").select("_row.*", F.col("norm_value").alias(out))
    if stated_only:
        return found
    return found.unionByName(keyed.where(~readable).select("_row.*", F.lit(None).cast("string").alias(out)))
