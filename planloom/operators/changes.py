"""Changes to records: validity, the latest of each key, merging by precedence, replacing and deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import blank_to_null


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects). A rule is true, or null for a missing value, where a row is fine; a reject has the names of the rules it breaks in ``broken``."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def finite_between(x: Column, low: float, high: float) -> Column:
    """True for a number in the bounds, false for NaN, infinity and others, null for null."""
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(~F.isnan(x) & (x >= low) & (x <= high))


def latest_values(changes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, columns): the latest non-null value of each column for each key, exact ties to the larger value; partial aggregation, no sort of a key's changes."""
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.col(c).alias("v"))))["v"].alias(c)
    return changes.groupBy(key).agg(*[newest(c) for c in columns])


def with_changes(rows: DataFrame, key: str, changes: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the changed values where there are any; rows without changes and all other columns stay."""
    new = changes.select(F.col(changes.columns[0]).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, rows[key] == new["_k"], "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}").cast(rows.schema[c].dataType), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def by_precedence(*values: Column) -> Column:
    """The first value that isn't null, empty or blank."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def merged_in_order(rows: DataFrame, key: str, order: str, columns: list[str], valid: dict[str, Column] | None = None) -> DataFrame:
    """(key, columns): of each column the value of the earliest row where it is present and valid."""
    valid = valid or {}
    present = lambda c: blank_to_null(F.col(c)).isNotNull() & F.coalesce(valid.get(c, F.lit(True)), F.lit(False))
    return rows.groupBy(key).agg(*[F.min(F.when(present(c), F.struct(F.col(order).alias("_o"), F.col(c).alias("v"))))["v"].alias(c) for c in columns])


def replaced(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``table`` with all rows of the keys in ``fresh`` replaced by its rows: the result of clearing and inserting."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_parents(children: DataFrame, parent_key: str, deleted: DataFrame) -> DataFrame:
    """Rows of ``children`` whose parent isn't in ``deleted`` (one column of keys): a delete that cascades."""
    gone = deleted.select(F.col(deleted.columns[0]).alias(parent_key)).distinct()
    return children.join(gone, parent_key, "left_anti").select(*children.columns)


def with_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``rows`` with the columns of ``wanted`` (name -> type) that it lacks, as nulls."""
    return rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in wanted.items() if name not in rows.columns])
