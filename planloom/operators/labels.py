"""Title-block labels matched to fields, and the values beside or below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions.similarity import ratio_from, token_set_ratio
from planloom.functions.text import label_key
from planloom.session import materialise

#: Fields and the labels that name them. Fixed values.
ALIASES = {
    "title": ("project title", "drawing title", "project name", "title", "job title"),
    "client": ("client", "client name", "owner", "developer", "employer"),
    "architect": ("architect", "architect name", "architectural firm"),
    "engineer": ("engineer", "consultant", "mechanical engineer", "services engineer", "building services", "m&e consultant", "mep engineer"),
    "project_address": ("project address", "address", "site address", "location", "site location"),
    "due_date": ("due date", "issue date", "date", "issued", "completion date", "tender date"),
}
#: Least similarities of words and of letters; longest label. Fixed values.
WORDS_LEAST, LETTERS_LEAST, LABEL_WORDS, LABEL_LETTERS = 85, 80, 3, 40


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, a) for f, names in ALIASES.items() for a in names], "field string, alias string")


def labelled_fields(labels: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """(label, fields): the fields whose aliases a label is alike enough; labels alike none are left out.

    ``known`` (field, alias) is a list of fixed size. It is folded into each label's row
    as an array, so each distinct label is compared once without a join.
    """
    listed = [(r["field"], r["alias"]) for r in known.distinct().orderBy("field", "alias").collect()]
    short = labels.where((F.length(label) <= LABEL_LETTERS) & (F.size(F.split(F.trim(label), r"\s+")) <= LABEL_WORDS)).select(label, label_key(F.col(label)).alias("_key")).where(F.col("_key") != "")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias")) for f, a in listed])
    alike = F.filter(pairs, lambda p: (ratio_from(F.col("_key"), p["alias"], LETTERS_LEAST) > 0) | (token_set_ratio(F.col("_key"), p["alias"], WORDS_LEAST) > 0))
    return short.select(label, F.explode(alike).alias("_p")).groupBy(label).agg(F.array_sort(F.collect_set("_p.field")).alias("fields"))


def map_labels(docs: DataFrame, known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, field, value, line_no): the value of each field's first label.

    ``docs`` has arrays of lines (``lines.document_lines``). ``LABEL: value`` takes the
    rest of the line; a label alone takes the next line if that is no label. A line that
    a stacked label took starts nothing itself. Whether a line matches is found once for
    each distinct text.
    """
    lines = docs.select(doc, F.explode("lines").alias("_l")).select(doc, "_l.line_no", "_l.text")
    parted = lines.withColumn("_left", F.when(F.col("text").contains(":"), F.regexp_extract("text", r"^([^:]*):", 1))).withColumn("_right", F.when(F.col("text").contains(":"), F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1))))
    typed = parted.select(F.explode(F.array("text", "_left")).alias("label")).where(F.col("label").isNotNull()).distinct()
    fields = materialise(labelled_fields(typed, "label", known), "labels")
    whole, left = fields.select(F.col("label").alias("text"), F.col("fields").alias("_whole")), fields.select(F.col("label").alias("_left"), F.col("fields").alias("_inline"))
    told = parted.join(whole, "text", "left").join(left, "_left", "left")
    inline = F.col("_inline").isNotNull() & (F.col("_right") != "")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text", "_right", F.col("_whole"), F.when(inline, F.col("_inline")).alias("_inline"))))
    rows = told.groupBy(doc).agg(ordered.alias("_all"))

    def at(i: Column) -> Column:
        return F.get("_all", i)

    def stacked(i: Column) -> Column:
        return F.coalesce((i >= 0) & at(i)["_inline"].isNull() & at(i)["_whole"].isNotNull() & at(i + 1).isNotNull() & at(i + 1)["_whole"].isNull(), F.lit(False))

    fired = F.transform(
        "_all",
        lambda x, i: F.when(x["_inline"].isNotNull() & ~stacked(i - 1), F.struct(x["_inline"].alias("fields"), x["_right"].alias("value"), x["line_no"].alias("line_no"))).when(
            stacked(i), F.struct(x["_whole"].alias("fields"), at(i + 1)["text"].alias("value"), x["line_no"].alias("line_no"))
        ),
    )
    each = rows.select(doc, F.explode(F.filter(fired, lambda f: f.isNotNull())).alias("_f")).select(doc, F.explode("_f.fields").alias("field"), F.col("_f.value").alias("value"), F.col("_f.line_no").alias("line_no"))
    return each.groupBy(doc, "field").agg(F.min(F.struct("line_no", "value")).alias("_m")).select(doc, "field", F.col("_m.value").alias("value"), F.col("_m.line_no").alias("line_no"))
