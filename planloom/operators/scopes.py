"""Scope sections read from pages: headings, the lists above and below them, and which list is the section's.

A page's lines are one array, each line with what it is; every list is cut out of it by
positions (first stop, last number, runs of text), so a page is worked on in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.operators import patterns as P
from planloom.operators import predicates as Q
from planloom.operators.sections import without_repeats

#: Lines a body, the list above a heading and the other places looked at may have; items of prose; loose notes. Fixed values.
BODY, ABOVE, BEFORE, WHOLE, PROSE, LOOSE = 90, 140, 80, 120, 25, 15
#: A section's list needs this score, and the list above a heading as many items to go first.
LEAST_SCORE, LEAST_ABOVE = 3, 3


def told_lines(lines: Column) -> Column:
    """Array of strings -> array of structs: position, text, and what the line is."""

    def tell(text: Column, i: Column) -> Column:
        numbered = text.rlike(P.NUMBERED)
        chrome = Q.is_title_block(text)
        label, cell = Q.is_label(text), Q.is_cell_label(text)
        short = F.size(Q.words(text)) <= 6
        ends = Q.has(text, P.SHEET_CHROME) | (~(label | cell) & ((Q.has(text, P.COMPANY) & short) | (Q.has(text, P.DISTRICT) & (short | (Q.has(text, r"\b(UNIFIED\s+)?SCHOOL\s+DISTRICT\b") & ~Q.has(text, P.WORK_VERB))))))
        noise = Q.has(text, P.JUNK_ITEM) | text.rlike(P.DIMENSION) | (numbered & (F.trim(F.regexp_extract(text, P.NUMBERED, 2)) == ""))
        return F.struct(
            i.alias("i"),
            text.alias("text"),
            Q.is_scope_heading(text).alias("heading"),
            numbered.alias("numbered"),
            F.regexp_extract(text, P.NUMBERED, 1).alias("number"),
            F.trim(F.regexp_extract(text, P.NUMBERED, 2)).alias("body"),
            Q.is_schedule(text).alias("schedule"),
            chrome.alias("chrome"),
            (label | cell).alias("named"),
            cell.alias("cell"),
            (ends & ~numbered).alias("ends"),
            ((chrome | label) & Q.has(text, P.STAMP_WORD)).alias("stamp"),
            (text.rlike(r"^[A-Za-z(]") & (F.length(text) > 15) & ~chrome & ~label & ~cell & ~noise).alias("running"),
            text.rlike("[.;:]$").alias("closed"),
        )

    return F.transform(lines, tell)


# The lists are worked out in named steps: an expression that held all of them would nest too deep for the analyser, and work the inner ones out again for every line.


def _first_at(lines: str, test) -> Column:
    """Index of the first line that ``test`` tells; null if none."""
    return F.array_min(F.filter(F.transform(lines, lambda x, k: F.when(test(x, k), k)), lambda k: k.isNotNull()))


def _all_at(lines: str, test) -> Column:
    return F.filter(F.transform(lines, lambda x, k: F.when(test(x, k), k)), lambda k: k.isNotNull())


def _head(lines: str, stop: str) -> Column:
    """The lines before index ``stop``, all where it is null."""
    return F.slice(lines, 1, F.coalesce(stop, F.size(lines)))


def _with_runs(df: DataFrame, lines: str) -> DataFrame:
    """``_runs``: the lines cut at the indices in ``_starts``; what stands before the first is left out."""
    return df.withColumn("_runs", F.transform("_starts", lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get("_starts", k + 1), F.size(lines)) - s)))


def with_numbered(df: DataFrame, lines: str, out: str) -> DataFrame:
    """Texts of numbered items: what follows the number and the lines up to one that ends it, names of cells left out."""
    df = _with_runs(df.withColumn("_starts", _all_at(lines, lambda x, k: x["numbered"])), lines)
    df = df.withColumn("_ends", F.transform("_runs", lambda run: F.array_min(F.filter(F.transform(run, lambda x, k: F.when(x["ends"] & (k > 0), k)), lambda k: k.isNotNull()))))
    kept = F.transform("_runs", lambda run, n: F.filter(F.slice(run, 1, F.coalesce(F.get("_ends", n), F.size(run))), lambda x, k: (k == 0) | ~x["named"]))
    df = df.withColumn("_kept", kept)
    texts = F.transform("_kept", lambda run: F.trim(F.array_join(F.transform(run, lambda x, k: F.when(k == 0, x["body"]).otherwise(x["text"])), " ")))
    return df.withColumn("_texts", F.filter(texts, lambda t: t != "")).withColumn(out, quality("_texts")).drop("_starts", "_runs", "_ends", "_kept", "_texts")


def with_prose(df: DataFrame, lines: str, out: str) -> DataFrame:
    """Sentences of running text: runs of text lines, each closed by its punctuation or by another kind of line; those that tell of work."""
    df = df.withColumn("_stop", _first_at(lines, lambda x, k: x["heading"] | x["stamp"])).withColumn("_part", _head(lines, "_stop"))
    df = df.withColumn("_starts", _all_at("_part", lambda x, k: x["running"] & ((k == 0) | ~F.get("_part", k - 1)["running"] | F.get("_part", k - 1)["closed"])))
    df = _with_runs(df, "_part")
    texts = F.transform("_runs", lambda run: Q.squeezed(F.array_join(F.transform(F.filter(run, lambda x: x["running"]), lambda x: x["text"]), " ")))
    df = df.withColumn("_texts", texts).withColumn("_told", F.slice(F.filter("_texts", Q.is_work_prose), 1, PROSE))
    return df.withColumn(out, quality("_told")).drop("_stop", "_part", "_starts", "_runs", "_texts", "_told")


def with_body(df: DataFrame, lines: str, out: str, most: int = BODY) -> DataFrame:
    """The part of a section's lines that may be its body: up to a heading or schedule, after the first number up to chrome; before it short lines only."""
    df = df.withColumn("_cap", F.slice(lines, 1, most)).withColumn("_first", F.coalesce(_first_at("_cap", lambda x, k: x["numbered"]), F.lit(1 << 30)))
    df = df.withColumn("_stop", _first_at("_cap", lambda x, k: x["heading"] | x["schedule"] | ((k > F.col("_first")) & ~x["numbered"] & (x["chrome"] | x["cell"]))))
    return df.withColumn(out, F.filter(_head("_cap", "_stop"), lambda x, k: (k >= F.col("_first")) | (F.length(x["text"]) <= 90))).drop("_cap", "_first", "_stop")


def with_above(df: DataFrame, lines: str, out: str) -> DataFrame:
    """The numbered block just above a heading: from the last number 1, else the first number, on."""
    df = df.withColumn("_blk", F.slice(lines, F.greatest(F.size(lines) - ABOVE + 1, F.lit(1)), ABOVE)).withColumn("_ones", _all_at("_blk", lambda x, k: x["numbered"] & (x["number"] == "1")))
    start = F.coalesce(F.array_max("_ones"), _first_at("_blk", lambda x, k: x["numbered"]), F.size("_blk"))
    return df.withColumn("_from", start).withColumn(out, F.slice("_blk", F.col("_from") + 1, F.size("_blk"))).drop("_blk", "_ones", "_from")


def quality(items: Column | str) -> Column:
    return F.transform(F.filter(items, Q.is_quality_item), Q.squeezed)


def scope_sections(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", lines: str = "lines") -> DataFrame:
    """(doc, page, heading_no, title, items, score) of each page's sections that have a list.

    ``lines``: array of cleaned lines of a page. Of the lists below the heading (numbered
    and prose), above it and, for a heading without either, elsewhere on the page, the
    best by score then length is the section's; the list above goes first where it is a
    real one and no shorter. A generic title takes none from above.
    """
    told = pages.select(doc, page, told_lines(F.col(lines)).alias("_l"))
    marks = told.withColumn("_h", F.transform(F.filter("_l", lambda x: x["heading"]), lambda x: x["i"]))
    each = marks.select(doc, page, "_l", "_h", F.posexplode("_h").alias("_n", "_at"))
    end = F.least(F.size("_l"), F.col("_at") + BODY, F.coalesce(F.get("_h", F.col("_n") + 1), F.size("_l")))
    each = each.withColumn("_end", end).withColumn("title", F.regexp_replace(F.get("_l", F.col("_at"))["text"], r":+\s*$", "")).withColumn("title", F.when(F.trim("title") == "", "Scope of Work").otherwise(F.trim("title")))
    first = F.col("_n") == 0
    nothing = F.slice("_l", 1, 0)
    each = each.withColumn("_below", F.slice("_l", F.col("_at") + 2, F.greatest(F.col("_end") - F.col("_at") - 1, F.lit(0)))).withColumn("_up", F.slice("_l", 1, F.col("_at")))
    each = with_body(each, "_below", "_after")
    each = with_prose(with_numbered(each, "_after", "_a"), "_after", "_p")
    each = with_above(each.withColumn("_over", F.when(first & ~Q.is_generic_title(F.col("title")), F.col("_up")).otherwise(nothing)), "_over", "_block")
    each = with_numbered(each, "_block", "_u")
    each = each.withColumn("_sa", Q.list_score(F.col("_a"))).withColumn("_sp", Q.list_score(F.col("_p"))).withColumn("_su", Q.list_score(F.col("_u")))
    # A first heading without a list of its own takes one from elsewhere on the page.
    each = each.withColumn("_weak", first & (F.col("_sa") < LEAST_SCORE) & (F.col("_sp") < LEAST_SCORE) & (F.size("_u") == 0))
    each = each.withColumn("_near", F.when(F.col("_weak"), F.slice("_up", F.greatest(F.size("_up") - BEFORE + 1, F.lit(1)), BEFORE)).otherwise(nothing)).withColumn("_whole", F.when(F.col("_weak") & (F.size("_h") == 1), F.col("_l")).otherwise(nothing))
    each = with_body(with_body(each, "_near", "_nb"), "_whole", "_wb", WHOLE)
    each = with_numbered(with_prose(with_numbered(each, "_nb", "_b"), "_nb", "_bp"), "_wb", "_w")
    choice = lambda name, score, order: F.struct(score.alias("score"), F.size(name).alias("size"), F.lit(-order).alias("order"), F.col(name).alias("items"))
    best = F.array_max(F.array(choice("_a", F.col("_sa"), 0), choice("_p", F.col("_sp"), 1), choice("_u", F.col("_su"), 2), choice("_b", Q.list_score(F.col("_b")), 3), choice("_bp", Q.list_score(F.col("_bp")), 4), choice("_w", Q.list_score(F.col("_w")), 5)))
    above = (F.col("_su") >= LEAST_SCORE) & (F.size("_u") >= F.greatest(F.lit(LEAST_ABOVE), F.size("_a")))
    each = each.withColumn("_best", F.when(above, choice("_u", F.col("_su"), 2)).otherwise(best))
    # A condition on what the steps found would be pushed below them all, and hold each of them again; a generator isn't.
    each = each.select(doc, page, "_n", "title", F.explode(F.filter(F.array("_best"), lambda x: x["score"] >= LEAST_SCORE)).alias("_best"))
    return each.select(doc, page, (F.col("_n") + 1).alias("heading_no"), "title", F.col("_best.items").alias("items"), F.col("_best.score").alias("score"))


def document_sections(sections: DataFrame, doc: str = "doc_id", page: str = "page_number") -> DataFrame:
    """(doc, scope_sections): a document's sections in order, without those that repeat another (``sections.without_repeats``)."""
    held = sections.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page_number"), "heading_no", "title", "items"))).alias("_s"))
    return held.select(doc, without_repeats(F.col("_s")).alias("scope_sections"))


def loose_notes(docs: DataFrame, doc: str = "doc_id", lines: str = "lines") -> DataFrame:
    """(doc, items): the longer lines under the first heading of notes, up to the next heading or label; documents without any are left out."""
    text = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["text"].alias("text")))
    told = docs.select(doc, text.alias("_l")).withColumn("_at", F.array_min(F.transform(F.filter("_l", lambda x: Q.has(x["text"], P.NOTES_HEADING)), lambda x: x["i"])))
    # Another heading of notes goes on with the same list.
    after = F.filter("_l", lambda x: (x["i"] > F.col("_at")) & ~Q.has(x["text"], P.NOTES_HEADING))
    told = told.withColumn("_a", after).withColumn("_stop", _first_at("_a", lambda x, k: Q.is_scope_heading(x["text"]) | Q.is_label(x["text"])))
    kept = F.filter(_head("_a", "_stop"), lambda x: F.length(x["text"]) > 20)
    items = F.slice(F.transform(kept, lambda x: x["text"]), 1, LOOSE)
    return told.select(doc, F.explode(F.filter(F.array(items), lambda x: F.size(x) > 0)).alias("items"))
