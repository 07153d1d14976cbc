"""Documents as ordered lines, and operations that depend on their order.

A document's lines stay together in one row as an array, so positional look-ups are
array expressions without a shuffle; ``exploded`` gives one row a line where a
condition is better tested on rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import LINE_BREAK, clean_line

#: Lines that are only the name of a title-block cell. Fixed values.
CELL_LABELS = (
    r"^(OF|SHEET|REVISION|CHK\s*BY|DWG\s*BY|SCALE|N\.?I\.?C\.?|DRAWING\s+INDEX|LOCATION\s+MAP|KEY\s+PLAN|SHEET\s+NO|FILE\s+LOCATION|DATE\s+PLOTTED|#|NO\.?)$"
)


def line_array(text: Column, keep_cell_labels: bool = True) -> Column:
    """Array of the cleaned, non-empty lines of a text; null for null."""
    lines = F.filter(F.transform(F.split(text, LINE_BREAK), clean_line), lambda x: x != "")
    return lines if keep_cell_labels else F.filter(lines, lambda x: ~x.rlike(f"(?i){CELL_LABELS}"))


def document_lines(pages: DataFrame, doc: str = "doc_id", page: str | None = None, text: str = "text") -> DataFrame:
    """(doc, lines): the lines of each document as structs (page_number, line_no, text), numbered through its pages.

    One page a document needs no shuffle; several are gathered by document. Documents
    without text have an empty array.
    """
    if page is None:
        lines = F.transform(F.coalesce(line_array(F.col(text)), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(1).alias("page_number"), (i + 1).alias("line_no"), x.alias("text")))
        return pages.select(doc, lines.alias("lines"))
    each = pages.select(doc, F.struct(F.col(page).alias("page_number"), F.coalesce(line_array(F.col(text)), F.array().cast("array<string>")).alias("_l")).alias("_p"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda p: F.transform(p["_l"], lambda x: F.struct(p["page_number"].alias("page_number"), x.alias("text")))))
    gathered = each.groupBy(doc).agg(flat.alias("_f"))
    return gathered.select(doc, F.transform("_f", lambda x, i: F.struct(x["page_number"].alias("page_number"), (i + 1).alias("line_no"), x["text"].alias("text"))).alias("lines"))


def exploded(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    return docs.select(doc, F.explode("lines").alias("_l")).select(doc, "_l.*")


def first_match(lines: DataFrame, doc: str, found: dict[str, Column]) -> DataFrame:
    """For each document and name, the value of the earliest line that gives one (not null); one partial aggregate, no sort."""
    return lines.groupBy(doc).agg(*[F.min(F.when(value.isNotNull(), F.struct(F.col("line_no"), value.alias("v"))))["v"].alias(name) for name, value in found.items()])


def best_line(lines: DataFrame, doc: str, score: Column, least: float, value: Column | None = None) -> DataFrame:
    """(doc, value, line_no, score) of the highest-scoring line that reaches ``least``; the earlier of equal ones."""
    scored = lines.withColumn("_s", score).where(F.col("_s") >= least)
    top = scored.groupBy(doc).agg(F.max(F.struct(F.col("_s").alias("score"), (-F.col("line_no")).alias("_n"), (value if value is not None else F.col("text")).alias("value"))).alias("_t"))
    return top.select(doc, F.col("_t.value").alias("value"), (-F.col("_t._n")).alias("line_no"), F.col("_t.score").alias("score"))


def next_lines(docs: DataFrame, test: Callable[[Column], Column], offset: int = 1, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, text, follower): each line that passes the test with the line ``offset`` further on, null past the end."""
    pairs = F.transform("lines", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), F.get("lines", i + offset)["text"].alias("follower")))
    return docs.select(doc, F.explode(F.filter(pairs, lambda p: test(p["text"]))).alias("_p")).select(doc, "_p.*")


def first_in_range(docs: DataFrame, anchor: Callable[[Column], Column], wanted: Callable[[Column], Column], after: int, before: int = 0, doc: str = "doc_id") -> DataFrame:
    """(doc, anchor_no, found_no, text): for each anchor line the first wanted line from ``before`` lines back to ``after`` lines on, itself left out."""
    hits = F.filter("lines", lambda x: anchor(x["text"]))
    near = docs.select(doc, "lines", F.explode(hits).alias("_a"))
    no = F.col("_a.line_no")
    start = F.greatest(no - before, F.lit(1))
    window = F.slice("lines", start, F.least(no + after, F.size("lines")) - start + 1)
    found = near.withColumn("_f", F.try_element_at(F.filter(window, lambda x: (x["line_no"] != no) & wanted(x["text"])), F.lit(1)))
    return found.where(F.col("_f").isNotNull()).select(doc, no.alias("anchor_no"), F.col("_f.line_no").alias("found_no"), F.col("_f.text").alias("text"))


def nearest_to_anchor(lines: DataFrame, anchor: Column, wanted: Column, reach: int, bonus: Column | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, value, line_no, score): the wanted line that scores best, ``reach`` less its distance to the document's first anchor line (0 at least) and a bonus."""
    at = lines.where(anchor).groupBy(doc).agg(F.min("line_no").alias("_at"))
    near = lines.where(wanted).join(at, doc, "left")
    points = F.coalesce(F.greatest(F.lit(0), F.lit(reach) - F.abs(F.col("line_no") - F.col("_at"))), F.lit(0)) + (bonus if bonus is not None else F.lit(0))
    return best_line(near, doc, points, 0)


def ordered_distinct(values: DataFrame, group: str, order: str, value: str, most: int, key: Column | None = None) -> DataFrame:
    """(group, position, value): the first of each distinct value (by ``key``, upper case if none), in order, at most ``most``: the cap is what the result is."""
    first = values.withColumn("_k", key if key is not None else F.upper(value)).groupBy(group, "_k").agg(F.min(F.struct(F.col(order).alias("_o"), F.col(value).alias("_v"))).alias("_m"))
    kept = first.groupBy(group).agg(F.slice(F.array_sort(F.collect_list("_m")), 1, most).alias("_all"))
    return kept.select(group, F.posexplode("_all").alias("_p", "_m")).select(group, (F.col("_p") + 1).alias("position"), F.col("_m._v").alias(value))


_ITEM = r"^([0-9]+)\.(?:\s+|$)(.*)$"


def numbered_items(docs: DataFrame, ends: Callable[[Column], Column] | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, item_no, number, text): numbered list items, each with the lines that follow it up to the next number.

    ``ends`` tells a line that ends an item; lines after it are left out until the next
    number. Lines before the first number belong to no item. A number alone on its line
    takes its text from the lines that follow. One fold over the document's lines.
    """
    start = F.array().cast("array<struct<number:int,parts:array<string>,open:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        text = x["text"]
        number = F.regexp_extract(text, _ITEM, 1)
        head = F.regexp_extract(text, _ITEM, 2)
        last = F.try_element_at(acc, F.lit(-1))
        ended = ends(text) if ends is not None else F.lit(False)
        new = F.struct(number.try_cast("int"), F.filter(F.array(head), lambda h: h != ""), F.lit(True)).cast("struct<number:int,parts:array<string>,open:boolean>")
        more = F.struct(last["number"], F.when(ended, last["parts"]).otherwise(F.array_append(last["parts"], text)), ~ended).cast("struct<number:int,parts:array<string>,open:boolean>")
        return F.when(number != "", F.array_append(acc, new)).when((F.size(acc) > 0) & last["open"], F.array_append(F.slice(acc, 1, F.size(acc) - 1), more)).otherwise(acc)

    items = F.aggregate("lines", start, step)
    told = docs.select(doc, F.posexplode(items).alias("_p", "_i"))
    return told.select(doc, (F.col("_p") + 1).alias("item_no"), F.col("_i.number").alias("number"), F.array_join("_i.parts", " ").alias("text"))


def while_open(docs: DataFrame, opens: Callable[[Column], Column], closes: Callable[[Column], Column], doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, text): the lines between an opening and the next closing line, both left out; the state runs on across pages."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<int>").alias("kept"))
    state = F.aggregate(
        "lines",
        start,
        lambda acc, x: F.when(opens(x["text"]), F.struct(F.lit(True).alias("open"), acc["kept"].alias("kept")))
        .when(closes(x["text"]), F.struct(F.lit(False).alias("open"), acc["kept"].alias("kept")))
        .when(acc["open"], F.struct(F.lit(True).alias("open"), F.array_append(acc["kept"], x["line_no"]).alias("kept")))
        .otherwise(acc),
    )
    return docs.select(doc, F.explode(F.transform(state["kept"], lambda i: F.get("lines", i - 1))).alias("_l")).select(doc, "_l.line_no", "_l.text")


def segments(docs: DataFrame, heading: Callable[[Column], Column], most: int | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, segment_no, title, body): the lines under each heading up to the next (``most`` of them where given)."""
    marks = F.transform(F.filter("lines", lambda x: heading(x["text"])), lambda x: x["line_no"])
    cut = docs.withColumn("_m", marks).select(doc, "lines", "_m", F.posexplode("_m").alias("_i", "_at"))
    end = F.coalesce(F.get("_m", F.col("_i") + 1), F.size("lines") + 1)
    size = end - F.col("_at") - 1
    body = F.slice("lines", F.col("_at") + 1, F.least(size, F.lit(most)) if most else size)
    return cut.select(doc, (F.col("_i") + 1).alias("segment_no"), F.get("lines", F.col("_at") - 1)["text"].alias("title"), F.transform(body, lambda x: x["text"]).alias("body"))


def page_stats(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pages, pages_with_text, lines)."""
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.trim(text) != "").alias("pages_with_text"), F.coalesce(F.sum(F.size(line_array(F.col(text)))), F.lit(0)).alias("lines"))
