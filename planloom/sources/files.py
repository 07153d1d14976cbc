"""File sources: JSON look-up tables, PDF files and the text of their pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"%PDF-"
RATES = "currency string, default_unit_cost double, rates map<string, struct<display_name string, unit_cost string>>"


class RatesError(ValueError):
    """A look-up file that is missing, no JSON or malformed."""


def rates_from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(device_type, display_name, unit_cost) and (currency, default_unit_cost) of one JSON file, checked as a whole."""
    try:
        raw = spark.read.schema(RATES).option("multiLine", True).option("mode", "FAILFAST").json(path).collect()
    except Exception as e:
        raise RatesError(f"{path}: not found or not valid JSON") from e
    if len(raw) != 1 or raw[0]["rates"] is None:
        raise RatesError(f"{path}: malformed")
    try:
        rows = [(k, v["display_name"], float(v["unit_cost"])) for k, v in raw[0]["rates"].items()]
    except (TypeError, ValueError, KeyError) as e:
        raise RatesError(f"{path}: malformed") from e
    if any(name is None for _, name, _ in rows):
        raise RatesError(f"{path}: malformed")
    entries = spark.createDataFrame(rows, "device_type string, display_name string, unit_cost double").withColumn("unit_cost", F.col("unit_cost").cast("decimal(18,4)"))
    meta = spark.createDataFrame([(raw[0]["currency"] or "USD", raw[0]["default_unit_cost"] or 0.0)], "currency string, default_unit_cost double")
    return entries, meta.withColumn("default_unit_cost", F.col("default_unit_cost").cast("decimal(18,4)"))


def pdf_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) PDF files of a folder by name, size and first bytes; a reject has the reason in ``error``.

    Files of no bytes have no content to offer: the file source doesn't deliver them, so they are in neither.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(path)
    error = F.when(F.col("length") > (most_bytes if most_bytes is not None else 1 << 62), "file too large").when(F.substring("content", 1, len(MAGIC)) != F.lit(MAGIC), "not a PDF")
    told = files.withColumn("error", error).dropDuplicates(["path"])
    return told.where(F.col("error").isNull()).drop("error"), told.where(F.col("error").isNotNull()).drop("content")


def pdf_pages(files: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(path, page_number, text) of PDF files, read where the files are; needs the optional ``fitz`` module on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    rows = [(path, i + 1, doc[i].get_text()) for i in range(min(len(doc), most_pages or len(doc)))]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, page_number int, text string")


def upright_text(spans: DataFrame, width: float, gap: float = 8.0, keys: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """(keys, text): vertical title-strip text put back in reading order.

    spans: keys and (x0, y0, dx, dy, text). Kept are spans that run vertically at the
    right of the page. Sorted by x0, a span more than ``gap`` from its column's first
    opens a new column; a column runs upwards if its first span does. A long text
    repeated in another case counts once. One fold over a page's spans.
    """
    kept = spans.where((F.abs("dy") >= 0.7) & (F.col("x0") >= 0.55 * width) & (F.trim("text") != ""))
    page = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "dy", "text"))).alias("_s"))
    kind = "array<struct<x:double,up:boolean,spans:array<struct<y:double,text:string>>>>"

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        own = F.struct(s["y0"].alias("y"), s["text"].alias("text"))
        new = F.struct(s["x0"].alias("x"), (s["dy"] < 0).alias("up"), F.array(own).alias("spans"))
        more = F.struct(last["x"].alias("x"), last["up"].alias("up"), F.array_append(last["spans"], own).alias("spans"))
        return F.when((F.size(acc) == 0) | (F.abs(s["x0"] - last["x"]) > gap), F.array_append(acc, new)).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), more))

    columns = F.aggregate("_s", F.array().cast(kind), step)
    ordered = F.flatten(F.transform(columns, lambda c: F.transform(F.when(c["up"], F.reverse(F.array_sort(c["spans"]))).otherwise(F.array_sort(c["spans"])), lambda x: F.trim(x["text"]))))
    texts = page.select(*keys, ordered.alias("_t"))
    once = F.filter("_t", lambda x, i: (F.length(x) <= 24) | (F.array_position(F.transform("_t", F.lower), F.lower(x)) == i + 1))
    return texts.select(*keys, F.array_join(once, "\n").alias("text"))
