"""Fields and texts that hold template residue, filler, failed exports, error pages or script notices.

Lines are normalised and counted by host. Lines that recur on a large part of a host's
records are boilerplate and are set aside where a record has other lines. What is left
of a record is judged by its evidence, line by line and as lines run together: patterns
for marks, and a list of sentences compared by edit distance (``pigeonhole_candidates``),
so that neither scanning noise in a sentence nor a line break or boilerplate within it
hides it.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm.pigeonhole import pigeonhole_candidates
from planloom.operators.skew import heavy_key_join
from planloom.session import materialise

#: A line is boilerplate of its host from this many records and this share of the host's records on.
BOILERPLATE_RECORDS, BOILERPLATE_SHARE = 20, 0.05

#: Edits allowed in a sentence, by the number of its letters and digits.
STEPS = ((6, 1), (9, 2))

# What a template asks for. Words of a slot between single brackets must be among these.
SLOT_WORDS = (
    "project proj title name client owner job number no nr num id site phase year yr yy date address city state zip phone fax firm company architect "
    "engineer consultant author sheet insert enter type add your text here value field placeholder tbd todo description subject location building district "
    "school revision rev drawing scope code district customer contractor agent email street unit room nombre proyecto projet titre cliente"
).split()
_SLOT = "|".join(SLOT_WORDS)
_SLOTTED = rf"[\s_.\-#:/]*(?:(?:{_SLOT})[\s_.\-#:/]*)+[a-z]?[\s_.\-#:/]*"

#: Marks of unfilled templates and failed exports, looked for anywhere in a lower-case line.
MARKS = (
    r"\{\{[^{}]{0,80}\}\}", r"\$\{[^{}]{0,80}\}", r"<<[^<>]{1,80}>>", r"«[^«»]{1,80}»", r"@@[^@]{1,80}@@", r"%%[^%]{1,80}%%", r"\[\[[^\[\]]{1,80}\]\]",
    r"<%[^%]{0,80}%>", r"(?:^|\s)%[a-z][a-z_]{1,40}%(?:\s|$)", r"(?:^|\s)\$[a-z][a-z_. ]{1,40}\$(?:\s|$)", r"(?:^|\s)__[a-z][a-z_. ]{0,60}__(?:\s|$)", r"\{[0-9]{1,2}\}",
    rf"\{{{_SLOTTED}\}}", rf"<{_SLOTTED}>", rf"\[{_SLOTTED}\]", rf"\(\s*(?:insert|enter|type|add)\s[a-z .]{{1,40}}\)",
    r"[\[<{(]\s*(?:insert|enter|type|add|your)\s[^\]>})]{1,60}[\]>})]", r"\[[#?x_ .]{2,}\]", r"<yr>|<n>|<nn>",
    r"(?:^|[\s/])x{4,}(?:[\s.,/-]|$)", r"_{4,}", r"\?{4,}",
    r"#(?:n/a|value!|ref!|name\?|div/0!|num!|null!|spill!)", r"\[object object\]",
)
#: Characters at which a mark begins or ends: a line that holds one may be a piece of a mark.
MARK_ENDS = r"[{}<>«»\[\]()@%$_]"
#: Whole lines without content.
WHOLE = (
    r"(?:x{2,}[\s.]*){1,}", r"[nxymd#?_.\-/\s]*(?:[nxymd#?_]{3,}|\.{4,})[nxymd#?_.\-/\s]*", r"[\s\[\](){}<>._#?*=-]*(?:\[\s*\]|\(\s*\)|\{\s*\}|[._#?*=]{4,})[\s\[\](){}<>._#?*=-]*",
    r"\(?\s*(?:null|nan|none|undefined|nil)\s*\)?(?:\s+(?:null|nan|none|undefined))*", r"(?:asdf|qwerty|test)(?:\s+(?:asdf|qwerty|test))*", r"foo\s*bar(?:\s*baz)?",
)
FILLER_WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud".split()

SLOT_NAMES = (
    "project title", "project name", "project", "title", "proj title", "job number", "job no", "job id", "job", "proj no", "project number", "project no", "client", "client name",
    "clientname", "owner", "owner name", "owners name", "customer", "customer name", "name", "text",
)


def evidence_sentences() -> list[tuple[str, str]]:
    """(kind, sentence): the sentences of templates, error pages and script notices, from their parts."""
    found: set[tuple[str, str]] = set()
    for lead, slot in product(("enter", "insert", "type", "add", "your", "enter your", "type your", "insert your"), SLOT_NAMES):
        found |= {("placeholder", f"{lead} {slot}"), ("placeholder", f"{lead} {slot} here")}
    found |= {("placeholder", f"{slot} goes here") for slot in SLOT_NAMES}
    found |= {
        ("placeholder", s)
        for s in ("text to be replaced", "to be replaced", "placeholder", "placeholder text", "title placeholder", "subtitle placeholder", "subtitle placeholder 1", "choose an item", "click here to enter text", "click or tap here to enter text", "click to add title", "click to add text", "click or tap to enter a date", "replace this text", "this text will be replaced", "template text")
    }
    found |= {("filler", s) for s in ("sample text", "dummy text", "texto de ejemplo", "texte d exemple", "exemple de texte", "beispieltext", "the quick brown fox jumps over the lazy dog")}
    codes = {"400": "bad request", "401": "unauthorized", "403": "forbidden", "404": "not found", "408": "request timeout", "410": "gone", "429": "too many requests", "500": "internal server error", "502": "bad gateway", "503": "service unavailable", "504": "gateway timeout"}
    words = {*codes.values(), "page not found", "server error", "file not found", "access denied", "no longer available"}
    for code, word in product(codes, words):
        found |= {("error", f"{code} {word}"), ("error", f"http {code} {word}"), ("error", f"error {code} {word}")}
    found |= {("error", f"{lead} {code}") for lead in ("error", "http error", "http") for code in codes}
    subjects = ("that file", "this file", "the file", "this page", "that page", "the page", "this link", "that link", "the plan room", "this document", "the document", "the requested document", "the requested page", "the requested file", "this site")
    ends = ("could not be loaded", "cannot be reached", "can not be reached", "does not exist", "has expired", "is down for maintenance", "could not be opened", "could not be found", "cannot be found", "cannot be displayed", "is missing or has been moved", "is not available", "is temporarily unavailable", "no longer exists", "is no longer available")
    for before, subject, end in product(("", "sorry ", "we are sorry ", "oops "), subjects, ends):
        found.add(("error", f"{before}{subject} {end}"))
    found |= {
        ("error", s)
        for s in ("access denied", "forbidden you don t have permission", "you don t have permission", "permission denied", "page not found", "file not found", "not found", "internal server error", "bad gateway", "gateway timeout", "service unavailable", "service temporarily unavailable", "temporarily unavailable", "down for maintenance", "request timed out", "request timed out code 7", "connection timed out", "your session has expired", "your session has expired please sign in again", "please sign in again", "please log in to continue", "an error occurred", "something went wrong", "an unexpected error occurred", "error file is missing or has been moved", "file is missing or has been moved", "pagina no encontrada", "error interno del servidor", "acceso denegado", "page introuvable", "page non trouvee", "erreur interne du serveur", "acces refuse", "document could not be opened")
    }
    verbs, things = ("enable", "activate", "allow", "permit", "turn on", "switch on"), ("js", "javascript", "scripts", "script support", "active content", "scripting")
    for verb, thing in product(verbs, things):
        for tail in ("", " and reload", " to go on", " to continue", " in your browser", " before you sign in", " to see this drawing", " to view this page"):
            found.add(("script", f"{verb} {thing}{tail}"))
        found.add(("script", f"please {verb} {thing} to view this page"))
    found |= {
        ("script", s)
        for s in ("enable js and cookies to continue", "enable javascript and cookies to continue", "javascript is disabled", "javascript is required", "scripts are disabled in your browser", "javascript is disabled in your browser", "this viewer needs scripts to be switched on", "you need to turn on javascript to run this app", "you need to enable javascript to run this app", "please enable javascript", "active scripting required", "your browser blocks scripts", "your browser does not support javascript", "votre navigateur bloque les scripts", "veuillez activer javascript", "active javascript", "por favor active javascript", "su navegador bloquea los scripts")
    }
    return sorted(found)


_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def normal_line(text: Column) -> Column:
    """Lower case, white space as single spaces, none outside."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))


def squashed(line: Column) -> Column:
    return F.regexp_replace(F.translate(line, *_ACCENTS), r"[^a-z0-9]", "")


def marked(line: Column) -> Column:
    """Whether a normalised line holds a mark, is without content, or is filler: patterns only."""
    filler = rf"\b(?:{'|'.join(FILLER_WORDS)})\b"
    words = F.size(F.split(line, " "))
    return line.rlike("|".join(MARKS)) | line.rlike(rf"^(?:{'|'.join(WHOLE)})$") | (F.regexp_count(line, F.lit(filler)) >= F.greatest(F.lit(2), F.floor(words / 2)))


def line_runs(lines: Column, longest: Column) -> Column:
    """Every run of two or more neighbours of ``lines`` (squashed, none empty), run together, of at most ``longest`` characters."""

    def longer(run: Column, line: Column) -> Column:
        text = F.concat(run["text"], line)
        fits = F.length(text) <= longest
        return F.struct(F.when(fits, text).alias("text"), F.when(fits, F.array_append(run["found"], text)).otherwise(run["found"]).alias("found"))

    def runs_from(first: Column, at: Column) -> Column:
        # Every line adds a character, so no run has more lines than characters.
        start = F.struct(first.alias("text"), F.array().cast("array<string>").alias("found"))
        return F.aggregate(F.slice(lines, at + 2, longest), start, longer, lambda run: run["found"])

    return F.array_distinct(F.flatten(F.transform(lines, runs_from)))


def residue_records(records: DataFrame, keys: list[str], host: str, text: str, sentences: DataFrame | None = None, spread: bool = False) -> DataFrame:
    """The ``keys`` (distinct) of records whose text, without its host's boilerplate, holds evidence.

    ``host`` names the column whose values share boilerplate (a site, a feed, a field).
    Null texts and texts without any character are no cases; a null host is one host;
    multi-line texts are judged line by line and as neighbouring lines run together; a
    record all of whose lines are boilerplate is judged by these. Where any value that
    contains evidence is a case, however far it spread, give ``spread=True``: records are then
    judged as written as well as without boilerplate. Lines are judged once each, whatever the number of
    records that hold them. Other columns don't matter.
    """
    spark = records.sparkSession
    if sentences is None:
        sentences = spark.createDataFrame(evidence_sentences(), "kind string, sentence string")
    rows = records.where(F.col(text).isNotNull()).select(*keys, F.coalesce(F.col(host), F.lit("")).alias("_host"), F.filter(F.transform(F.split(F.col(text), r"[\r\n  ]+"), normal_line), lambda x: x != "").alias("_all")).withColumn("_lines", F.array_distinct("_all"))
    single = F.size("_lines") == 1
    lines = rows.select(*keys, "_host", single.alias("_single"), F.explode("_lines").alias("_line"))
    counted = materialise(lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_single"), 0).otherwise(1)).alias("_several")), "host-lines")
    hosts = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_records"))
    # Only lines of records with several lines can be set aside, so the rest needs no share.
    recurrent = counted.where((F.col("_several") > 0) & (F.col("_n") >= BOILERPLATE_RECORDS)).join(hosts, "_host").where(F.col("_n") >= BOILERPLATE_SHARE * F.col("_records")).select("_host", "_line", F.lit(True).alias("_common"))
    refs = sentences.select(squashed(F.lower("sentence")).alias("_sentence")).where(F.col("_sentence") != "").distinct()
    known = refs.agg((F.coalesce(F.max(F.length("_sentence")), F.lit(0)) + max(e for _, e in STEPS)).alias("_longest"), F.array_join(F.collect_list("_sentence"), " ").alias("_sentences"))
    piece = (squashed(F.col("_line")) != "") & F.contains("_sentences", squashed(F.col("_line"))) | F.col("_line").rlike(MARK_ENDS)
    aside = recurrent.crossJoin(F.broadcast(known)).select("_host", "_line", piece.alias("_piece"))
    # What is left of each text of several lines, in order; the same text of a host is one.
    several = rows.where(F.size("_lines") > 1).select(*keys, "_host", "_all", F.sha2(F.to_json(F.struct("_host", "_all")), 256).alias("_record"))
    each = several.select("_record", "_host", F.posexplode("_all").alias("_at", "_line")).join(aside, ["_host", "_line"], "left")
    held = each.groupBy("_record").agg(F.count_if(F.col("_at") == 0).alias("_n"), F.sort_array(F.collect_set(F.struct("_at", "_line", "_piece"))).alias("_held"))
    held = held.withColumn("_left", F.filter("_held", lambda x: x["_piece"].isNull()))
    held = held.withColumn("_left", F.when(F.size("_left") > 0, F.col("_left")).otherwise(F.col("_held")))
    # Where residue that spread counts, a recurrent line may be a piece of it: such lines are left in once, and all lines once.
    judge = [F.col("_left"), F.filter("_held", lambda x: F.coalesce(x["_piece"], F.lit(True))), F.col("_held")] if spread else [F.col("_left")]
    parts = held.select("_record", "_n", F.explode(F.array_distinct(F.array(*[F.transform(x, lambda y: y["_line"]) for x in judge]))).alias("_part")).where(F.size("_part") > 1)
    parts = parts.crossJoin(F.broadcast(known.select("_longest"))).withColumn("_squashes", F.filter(F.transform("_part", squashed), lambda x: x != ""))
    parts = materialise(parts.select("_record", "_n", F.array_join("_part", " ").alias("_text"), line_runs(F.col("_squashes"), F.col("_longest")).alias("_runs")), "left-texts")
    runs = parts.select("_record", "_n", F.explode("_runs").alias("_squash"))
    # Judge each line once.
    judged = counted.groupBy("_line").agg(F.sum("_n").alias("_n"))
    by_mark = judged.where(marked(F.col("_line"))).select("_line")
    squash = judged.select("_line", squashed(F.col("_line")).alias("_squash")).where(F.col("_squash") != "")
    near = materialise(pigeonhole_candidates(squash.select("_squash").unionByName(runs.select("_squash")).distinct(), refs, "_squash", "_sentence", STEPS).select("_squash").distinct(), "evidence-squashes")
    bad = materialise(by_mark.unionByName(squash.join(near, "_squash").select("_line")).distinct(), "evidence-lines")
    together = parts.where(marked(F.col("_text"))).select("_record", "_n").unionByName(runs.join(near, "_squash").select("_record", "_n")).distinct()
    across = heavy_key_join(several.select(*keys, "_record"), together, ["_record"], "_n").select(*keys)
    evidence = bad.join(judged, "_line")
    hits = heavy_key_join(lines, evidence, ["_line"], "_n")
    if spread:
        return hits.select(*keys).unionByName(across).distinct()
    # A hit on a boilerplate line counts only where the record has no other line.
    hits = hits.join(recurrent, ["_host", "_line"], "left")
    plain = hits.where(F.col("_single") | F.col("_common").isNull()).select(*keys)
    whole = hits.where(~F.col("_single") & F.col("_common").isNotNull()).select(*keys, "_host").distinct()
    left = lines.where(~F.col("_single")).join(recurrent, ["_host", "_line"], "left_anti").select(*keys).distinct()
    return plain.unionByName(whole.select(*keys).join(left, keys, "left_anti")).unionByName(across).distinct()
