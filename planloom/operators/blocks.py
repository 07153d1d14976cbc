"""Parties, identifiers, dates and addresses read from the lines of a title block.

The lines of a document (or of one page) are one array, each line with what it is, so
neighbours and distances are positions in it; every field is an expression over the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions.text import fingerprint, format_phone, title_case
from planloom.operators import patterns as P
from planloom.operators import predicates as Q

#: How far a look-up reaches. Fixed values.
AGENT_REACH, DATE_REACH, OWNER_REACH, CONSULTANT_REACH, DISTRICT_REACH, COMPANY_NEAR, SITES_MOST = 11, 19, 7, 5, 7, 8, 4
#: Weights of the issue date and the site address. Fixed values.
DATE_WEIGHTS = {"month": 8, "near": 15, "renewal": -20}
SITE_WEIGHTS = {"title": 20, "school": 12, "street": 8, "suite": -12, "office": -10, "city": -6}

#: The column of lines that the expressions read.
L = "_l"
Test = Callable[[Column], Column]


def with_lines(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """``docs`` with ``_l``: its lines as structs of position, text and what the line is."""

    def tell(x: Column, i: Column) -> Column:
        t = x["text"]
        flags = {
            "up": F.upper(t), "street": Q.has(t, P.STREET), "zip": t.rlike(P.ZIP_LINE), "state_zip": Q.has(t, P.STATE_ZIP), "one": Q.has(t, P.ONE_LINE_ADDRESS), "label": Q.is_label(t), "company": Q.has(t, P.COMPANY), "district": Q.has(t, P.DISTRICT),
            "phone": t.rlike(P.STANDALONE_PHONE), "path": Q.is_path_or_url(t), "disclaimer": Q.is_disclaimer(t), "goes_on": Q.has(t, P.TITLE_GOES_ON), "school": Q.has(t, P.SCHOOL), "dated": Q.has(t, P.DATE_VALUE), "numbered": t.rlike(P.NUMBERED),
        }
        return F.struct(i.alias("i"), t.alias("text"), *[v.alias(k) for k, v in flags.items()])

    return docs.withColumn("_l", F.transform(lines, tell))


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def at(i: Column | int) -> Column:
    """The line at a position; null outside."""
    return F.when(F.lit(i) >= 0 if isinstance(i, int) else i >= 0, F.get(L, F.lit(i) if isinstance(i, int) else i))


def first(test: Test, lines: Column | str = L) -> Column:
    return F.try_element_at(F.filter(lines, test), F.lit(1))


def first_of(values: Column) -> Column:
    """The first value that isn't null."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def between(start: Column, end: Column) -> Column:
    """The lines from position ``start`` to ``end``, both included; none for a null position."""
    low = F.greatest(start, F.lit(0))
    return F.coalesce(F.slice(L, low + 1, F.greatest(F.least(end, F.size(L) - 1) - low + 1, F.lit(0))), F.slice(L, 1, 0))


def tidy(x: Column) -> Column:
    return F.regexp_replace(Q.squeezed(x), r"^[ ,]+|[ ,]+$", "")


def labelled(x: Column, pattern: str) -> Column:
    """The value after a label; an empty string where the label stands alone, null where it isn't there."""
    return F.when(Q.has(x["text"], pattern), F.trim(F.regexp_extract(x["text"], f"(?i){pattern}", 1)))


def phone_in(x: Column) -> Column:
    return format_phone(F.nullif(F.regexp_extract(x, P.STANDALONE_PHONE, 0), F.lit("")))


def two_lines(x: Column, any_state: bool = True) -> Column:
    """A street line and the town line below it as one address; else null."""
    below = at(x["i"] + 1)
    return F.when(x["street"] & _no(below["zip"] | (below["state_zip"] if any_state else F.lit(False))), F.concat(x["text"], F.lit(", "), below["text"]))


def site_candidate(x: Column) -> Column:
    return F.coalesce(two_lines(x, any_state=False), F.when(Q.has(x["text"], P.STREET_TO_ZIP), x["text"]))


def is_architect_set(lines: Column | str = L) -> Column:
    """Whether lines are of an architect's set: they name a project owner, or a school district and consultants but no agent."""
    t = F.array_join(F.transform(lines, lambda x: x["up"]), " ")
    return t.contains("PROJECT OWNER") | (t.contains("SCHOOL DISTRICT") & t.contains("CONSULTANTS") & ~t.contains("AGENT:"))


# ---- identifiers and dates


def job_number() -> Column:
    """A line that is a job number; else what follows the label, on its line or below."""
    own = F.trim(first(lambda x: F.trim(x["text"]).rlike(P.JOB_VALUE))["text"])
    return F.coalesce(own, labelled_job())


def labelled_job() -> Column:
    label = first(lambda x: Q.has(x["text"], P.JOB_LABEL))
    return F.coalesce(F.nullif(labelled(label, P.JOB_LABEL), F.lit("")), at(label["i"] + 1)["text"])


def licence() -> Column:
    whole = first(lambda x: Q.has(F.trim(x["text"]), P.LICENCE_LINE))["text"]
    return F.upper(F.coalesce(F.trim(whole), Q.caught(first(lambda x: Q.has(x["text"], P.LICENCE))["text"], P.LICENCE)))


def issue_date(job: Column) -> Column:
    """The date that best fits an issue date: with a month's name, near the job number, no renewal, plot or code date; as typed."""
    job_at = first(lambda x: x["text"].contains(job))["i"]

    def score(x: Column) -> Column:
        raw = Q.caught(x["text"], P.DATE_VALUE)
        named = raw.rlike("[A-Za-z]{3}") & raw.rlike(r"\d{4}")
        return F.when(named, DATE_WEIGHTS["month"]).otherwise(0) + F.coalesce(F.greatest(F.lit(0), DATE_WEIGHTS["near"] - F.abs(x["i"] - job_at)), F.lit(0)) + F.when(_no(at(x["i"] - 1)["up"].startswith("REN")), DATE_WEIGHTS["renewal"]).otherwise(0)

    other = lambda x: x["up"].contains("PLOTTED") | x["up"].startswith("REN") | x["up"].rlike(r"\b(EFFECTIVE|APPLICABLE\s+CODES?|APPLICABLE\s+STANDARDS)\b") | x["text"].rlike(r"\b\d{1,2}:\d{2}:\d{2}\b")
    scored = F.transform(F.filter(L, lambda x: x["dated"] & ~other(x)), lambda x: F.struct((-score(x)).alias("minus"), x["i"].alias("i"), Q.caught(x["text"], P.DATE_VALUE).alias("raw")))
    return F.array_min(scored)["raw"]


def labelled_date() -> Column:
    """The date after the first DATE label, on its line or within reach below, else the first short line with a date; as typed."""
    label = first(lambda x: Q.has(x["text"], P.DATE_LABEL))
    value = labelled(label, P.DATE_LABEL)
    inline = F.when((value != "") & ~Q.is_label(value), Q.caught(value, P.DATE_VALUE))
    passed = lambda x: x["label"] | (Q.has(x["text"], r"\b(CHK|DWG|DRAWN|BY)\b") & x["text"].contains(":")) | Q.has(x["text"], P.AGENT_LABEL) | x["company"]
    short = lambda x: x["dated"] & (F.length(x["text"]) <= 40)
    below = first(lambda x: short(x) & ~passed(x), between(label["i"] + 1, label["i"] + DATE_REACH))
    anywhere = first(lambda x: short(x) & ~x["label"] & ~Q.has(x["text"], r"\b(CHK|DWG|PLOTTED|REN)\b"))
    return F.coalesce(inline, Q.caught(F.coalesce(below["text"], anywhere["text"]), P.DATE_VALUE))


# ---- titles and owners


def project_title() -> Column:
    """A line that names a school and the work, else a school's line with up to three lines that go on with it."""
    clean = lambda t: F.regexp_replace(Q.squeezed(t), "^[ &]+|[ &]+$", "")
    one = first(lambda x: ~x["path"] & x["goes_on"] & x["school"] & (F.length(clean(x["text"])).between(9, 119)) & ~Q.has(clean(x["text"]), P.DISTRICT))

    def follows(y: Column) -> Column:
        short = (F.size(Q.words(y["text"])) <= 4) & Q.is_capitals(y["text"]) & ~y["zip"] & ~y["text"].rlike(P.JOB_VALUE)
        return _no(~y["path"] & (y["goes_on"] | short) & ~y["district"] & ~y["street"] & ~y["dated"])

    def parts(x: Column) -> Column:
        a, b, c = (at(x["i"] + n) for n in (1, 2, 3))
        n = F.when(~follows(a), 0).when(~follows(b), 1).when(~follows(c), 2).otherwise(3)
        next_three = F.array_join(F.transform(between(x["i"] + 1, x["i"] + 3), lambda y: y["text"]), " ")
        code_sheet = ~Q.has(next_three, P.TITLE_GOES_ON) & ~x["goes_on"] & Q.has(x["text"], r"\bELEMENTARY\s+SCHOOL\b") & ~x["text"].rlike(r"\bES\b")
        named = ~x["path"] & (x["school"] | Q.has(x["text"], r"\b(ELEMENTARY|MIDDLE|HIGH\s+SCHOOL)\b")) & ~x["district"] & ~code_sheet
        text = F.array_join(F.transform(between(x["i"], x["i"] + n), lambda y: F.trim(y["text"])), " ")
        return F.when(named & ((n >= 1) | x["goes_on"]), text)

    return F.coalesce(clean(one["text"]), clean(first_of(F.transform(L, parts))))


def owner_district() -> Column:
    """The first school district named, on one line or two."""

    def named(x: Column) -> Column:
        below = at(x["i"] + 1)
        joined = F.when(_no(below["up"].contains("DISTRICT")), F.concat(x["text"], F.lit(" "), below["text"])).otherwise(x["text"])
        split = x["up"].isin("MOUNT DIABLO UNIFIED", "MT. DIABLO UNIFIED") & below.isNotNull()
        good = Q.has(joined, r"SCHOOL\s+DISTRICT") & (F.length(joined) < 120) & ~Q.is_disclaimer(joined)
        return F.when(good, joined).when(split, F.concat(x["text"], F.lit(" "), below["text"]))

    return Q.squeezed(first_of(F.transform(L, named)))


def owner_line() -> Column:
    """The first short district line, or the first district below the owner's label, whichever stands first."""
    own = lambda x: x["district"] & (F.length(x["text"]).between(11, 119)) & (F.length(x["text"]) - F.length(F.replace(x["text"], F.lit(" "), F.lit(""))) <= 10) & ~x["numbered"]
    label = lambda x: Q.has(x["text"], r"^PROJECT\s+OWNER") & at(x["i"] + 1).isNotNull()
    hit = first(lambda x: own(x) | label(x))
    below = first(lambda x: x["district"] & ~x["label"] & ~x["street"] & ~x["zip"] & ~x["state_zip"], between(hit["i"] + 1, hit["i"] + OWNER_REACH))
    return F.when(own(hit), hit["text"]).otherwise(below["text"])


def short_title() -> Column:
    """The line that reads most like a project's title: of a school, then the shorter, then the earlier."""
    schoolish = lambda x: x["up"].rlike(r"\b(ELEMENTARY|MIDDLE|HIGH|SCHOOL)\b")
    other = lambda x: x["district"] | x["street"] | x["zip"] | x["state_zip"] | x["one"] | (x["company"] & ~x["up"].contains("SCHOOL")) | x["numbered"] | (F.length(x["text"]) > 80) | (F.size(Q.words(x["text"])) > 12)
    chrome = lambda x: F.exists(F.array(*map(F.lit, P.NO_TITLE)), lambda k: x["up"].contains(k))
    told = F.transform(F.filter(L, lambda x: Q.has(x["text"], P.TITLE_WORD) & ~other(x) & ~chrome(x)), lambda x: F.struct((~schoolish(x)).alias("other"), F.length(x["text"]).alias("n"), x["i"].alias("i"), x["text"].alias("text")))
    return F.array_min(told)["text"]


# ---- addresses and offices


def site_address(title: Column) -> Column:
    """The address that best fits the project's site: near its title and school, on a street, no suite, not beside a licence or phone."""
    word = F.upper(F.get(Q.words(title), F.lit(0)))
    school_at = first(lambda x: x["school"] & ~x["district"] & ~x["path"])["i"]
    title_at = F.coalesce(F.when(~Q.is_path_or_url(title), first(lambda x: x["up"].contains(word) & ~x["path"])["i"]), school_at)
    near = lambda i, anchor, reach: F.coalesce(F.greatest(F.lit(0), F.lit(reach) - F.abs(i - anchor)), F.lit(0))

    def score(x: Column, c: Column) -> Column:
        around = F.array_join(F.transform(between(x["i"] - 3, x["i"] + 2), lambda y: y["up"]), " ")
        w = SITE_WEIGHTS
        office = around.rlike(r"\bC-\d{4,6}\b") | around.rlike(r"\bTEL\b")
        city = (F.upper(c).contains("HEDDING") | F.upper(c).contains("SAN JOSE")) & _no(F.abs(x["i"] - title_at) > 2)
        return (
            near(x["i"], title_at, w["title"]) + near(x["i"], school_at, w["school"]) + F.when(Q.has(c, r"\b(AVE|AVENUE|RD|ROAD|DR|DRIVE|BLVD)\b"), w["street"]).otherwise(0)
            + F.when(Q.has(c, r"\bSUITE\b"), w["suite"]).otherwise(0) + F.when(office, w["office"]).otherwise(0) + F.when(city, w["city"]).otherwise(0)
        )

    told = F.transform(F.filter(L, lambda x: site_candidate(x).isNotNull()), lambda x: F.struct((-score(x, site_candidate(x))).alias("minus"), x["i"].alias("i"), site_candidate(x).alias("text")))
    return F.array_min(told)["text"]


def plain_site(provider_address: Column) -> Column:
    """The first address that isn't the provider's: of two lines, or on one line in California; else the first line with a postcode."""
    differs = lambda t: _no(t != provider_address) | provider_address.isNull()
    loose = first(lambda x: x["zip"] & ~x["street"] & x["text"].rlike(r"\d") & differs(x["text"]))
    same = lambda t: _no(fingerprint(t) == fingerprint(provider_address))
    one = lambda x: x["one"] & differs(x["text"]) & ~same(x["text"]) & x["up"].contains("CA") & (Q.has(x["text"], r"\b(CA|CALIFORNIA)\b") | loose.isNull() | (loose["i"] > x["i"]))
    sure = first_of(F.transform(L, lambda x: F.coalesce(F.when(differs(two_lines(x)), two_lines(x)), F.when(one(x), x["text"]))))
    return F.coalesce(sure, loose["text"])


def architect_office() -> Column:
    """Struct (company, phone, address) of the architect's office: around a licence line, else above the first phone before the consultants."""
    tel = lambda x: x["phone"] & (x["up"].startswith("TEL") | x["up"].contains("PHONE"))

    def around(x: Column) -> Column:
        start, end = x["i"] - 2, x["i"] + 7
        window = between(start, end)
        last = lambda test: F.try_element_at(F.filter(window, test), F.lit(-1))
        place = last(lambda y: y["street"] & _no(at(y["i"] + 1)["zip"]) & (y["i"] < end))
        firm = last(lambda y: y["company"] & ~y["disclaimer"] & ~y["district"] & F.size(Q.words(y["text"])).between(2, 8))
        return F.struct(firm["text"].alias("company"), phone_in(last(tel)["text"]).alias("phone"), F.concat(place["text"], F.lit(", "), at(place["i"] + 1)["text"]).alias("address"))

    stamps = F.transform(F.filter(L, lambda x: Q.has(F.trim(x["text"]), P.LICENCE_LINE)), around)
    stamp = F.try_element_at(F.filter(stamps, lambda s: s["phone"].isNotNull() | s["address"].isNotNull()), F.lit(1))
    consultants = F.coalesce(first(lambda x: x["up"] == "CONSULTANTS")["i"], F.size(L))
    phone = first(lambda x: (x["i"] < consultants) & (x["up"].startswith("TEL") | x["up"].startswith("PHONE")) & x["phone"])
    back = F.try_element_at(F.filter(between(phone["i"] - 3, phone["i"] - 1), lambda y: y["street"] | y["zip"]), F.lit(-1))
    above = at(back["i"] - 1)
    found = F.concat_ws(", ", F.when(_no(above["street"]), above["text"]), back["text"])
    designer = first(lambda x: Q.has(x["text"], r"\b(ARCHITECTURE|ARCHITECTS|DESIGN)\b") & Q.has(x["text"], r"\b(INC|LLC|LLP|STUDIO|GROUP)\b") & ~x["disclaimer"] & ~x["district"])
    company = F.coalesce(stamp["company"], first_of(F.transform(F.when(stamp.isNull(), F.reverse(stamps)), lambda s: s["company"])), designer["text"])
    bare = stamp["phone"].isNull()
    return F.struct(company.alias("company"), F.coalesce(stamp["phone"], phone_in(phone["text"])).alias("phone"), F.coalesce(F.when(bare & back.isNotNull(), F.nullif(found, F.lit(""))), stamp["address"]).alias("address"))


def any_phone() -> Column:
    return phone_in(first(lambda x: x["phone"] & (x["up"].startswith("TEL") | x["up"].contains("PHONE")))["text"])


def agent() -> Column:
    """The person named by the first AGENT label, on its line or in capitals within reach, else the first line in capitals that is a name."""
    label = first(lambda x: Q.has(x["text"], P.AGENT_LABEL))
    value = labelled(label, P.AGENT_LABEL)
    shouted = lambda x: Q.is_capitals(x["text"]) & Q.is_person(x["text"])
    below = first(shouted, between(label["i"] + 1, label["i"] + AGENT_REACH))
    return F.when(label.isNotNull(), F.coalesce(F.when(Q.is_person(value), value), title_case(below["text"]), title_case(first(shouted)["text"])))


def vendor() -> Column:
    """The line that reads most like the vendor's name: its legal form and words of a company, the earlier of equals."""

    def score(x: Column) -> Column:
        t, up = x["text"], x["up"]
        add = lambda test, n: F.when(test, n).otherwise(0)
        return (
            add(Q.has(t, r"\bCOMPANY\b"), 3) + add(Q.has(t, r"\bINC\.?\b|\bLLC\b"), 4) + add(up.contains("THE ") & up.rlike(r"\b(INC|LLC|COMPANY)\b"), 2) + add(up.contains("GARLAND"), 5)
            + add(up.rlike(r"\bDESIGN\b") & up.rlike(r"\bINC\b"), 3)
        )

    fit = lambda x: x["company"] & F.size(Q.words(x["text"])).between(2, 10) & ~x["district"] & ~Q.has(x["text"], P.DISCIPLINE) & ~F.exists(F.array(*map(F.lit, P.NO_COMPANY)), lambda k: x["up"].contains(k)) & (score(x) >= 2)
    return F.array_min(F.transform(F.filter(L, fit), lambda x: F.struct((-score(x)).alias("minus"), x["i"].alias("i"), x["text"].alias("text"))))["text"]


def vendor_address(company: Column) -> Column:
    """The first address near the vendor's line, else the first of all."""
    place = first(lambda x: x["text"] == company)["i"]
    candidate = lambda x: F.coalesce(F.when(x["one"], Q.squeezed(x["text"])), two_lines(x))
    near = first_of(F.transform(L, lambda x: F.when(_no(F.abs(x["i"] - place) <= COMPANY_NEAR), candidate(x))))
    return F.coalesce(near, first_of(F.transform(L, candidate)))


# ---- blocks as rows


def architect_block(docs: DataFrame, doc: str) -> DataFrame:
    """The fields of an architect's title block; docs has ``_l``. Dates are as typed."""
    told = docs.select(doc, "_l", owner_district().alias("client"), project_title().alias("project_title"), job_number().alias("job_number"), licence().alias("aor_license"), architect_office().alias("_o"))
    return told.select(
        doc, "client", "project_title", "job_number", issue_date(F.col("job_number")).alias("date"), site_address(F.col("project_title")).alias("site_address"), "aor_license",
        F.col("_o.company").alias("provider_company"), F.coalesce("_o.phone", any_phone()).alias("provider_phone"), F.col("_o.address").alias("provider_address"),
    )


def vendor_block(docs: DataFrame, doc: str) -> DataFrame:
    """The fields of a vendor's title block and of the project on it; docs has ``_l``. Dates are as typed."""
    fax = first_of(F.transform(L, lambda x: Q.caught(x["text"], P.FAX)))
    phone = first_of(F.transform(L, lambda x: Q.caught(x["text"], P.PHONE)))
    told = docs.select(doc, "_l", agent().alias("provider_agent"), vendor().alias("provider_company"), format_phone(phone).alias("provider_phone"), format_phone(fax).alias("provider_fax"))
    told = told.withColumn("provider_address", vendor_address(F.col("provider_company")))
    own = [c for c in told.columns if c not in (doc, "_l")]
    return told.select(doc, *own, owner_line().alias("client"), short_title().alias("project_title"), plain_site(F.col("provider_address")).alias("site_address"), labelled_job().alias("job_number"), labelled_date().alias("date"))


def consultants_found() -> Column:
    """Array of structs (discipline, firm, phone, address): each discipline's heading, also letter-spaced, with what stands below it up to the next."""
    tight = lambda x: F.regexp_replace(x["text"], r"\s+", "")
    plain = lambda x: Q.has(x["text"], P.DISCIPLINE)
    heading = lambda x: plain(x) | Q.has(tight(x), P.SPACED_DISCIPLINE)

    def read(x: Column) -> Column:
        reach = between(x["i"] + 1, x["i"] + CONSULTANT_REACH)
        stop = F.array_min(F.transform(F.filter(reach, lambda y: plain(y) | F.upper(tight(y)).endswith("ENGINEER")), lambda y: y["i"]))
        below = F.filter(reach, lambda y: stop.isNull() | (y["i"] < stop))
        firm = first(lambda y: (y["company"] | ~y["phone"]) & ~y["label"], below)
        others = F.filter(below, lambda y: y["i"] != firm["i"])
        phone = first(lambda y: y["phone"], others)
        places = F.transform(F.filter(others, lambda y: (phone.isNull() | (y["i"] != phone["i"])) & (y["street"] | y["zip"])), lambda y: y["text"])
        discipline = F.when(plain(x), title_case(x["text"])).otherwise(F.concat(title_case(Q.caught(tight(x), P.SPACED_DISCIPLINE)), F.lit(" Engineer")))
        return F.struct(discipline.alias("discipline"), firm["text"].alias("firm"), phone_in(phone["text"]).alias("phone"), F.nullif(F.array_join(places, ", "), F.lit("")).alias("address"))

    return F.filter(F.transform(F.filter(L, heading), read), lambda c: c["firm"].isNotNull())


# ---- over cover and document


def _of_project(x: Column) -> Column:
    return ~x["up"].rlike(P.STATE_NUMBER_FEATURE) & (F.regexp_count(x["text"], F.lit(P.STATE_NUMBER)) <= 1) & (F.length(x["text"]) <= 60)


def state_number(cover: Column, everything: Column) -> Column:
    """The project's number with the state: labelled anywhere, the cover first; else beside or below its label on the cover."""
    anywhere = F.concat(cover, everything)
    strict = first_of(F.transform(anywhere, lambda x: F.when(_of_project(x), Q.caught(x["text"], P.STATE_NUMBER_LABELLED))))
    ends = lambda x: Q.has(x["text"], r"DSA\s*#?\s*$")

    def loose(x: Column, i: Column) -> Column:
        marked = x["up"].contains("DSA #") | x["up"].contains("DSA#")
        below = F.get(cover, i + 1)
        own = F.when(_of_project(x) & (marked | F.trim(x["up"]).startswith("DSA")), Q.caught(x["text"], P.STATE_NUMBER))
        under = F.when(ends(x) & _no(_of_project(below)), F.nullif(F.regexp_extract(F.trim(below["text"]), r"^(0\d-\d{5,7})$", 1), F.lit("")))
        seen = (_of_project(x) | ends(x)) & x["up"].contains("DSA") & ((F.length(x["text"]) <= 80) | marked)
        return F.when(seen, F.coalesce(own, under))

    return F.coalesce(strict, first_of(F.transform(cover, loose)))


def work_type(title: Column, lines: Column) -> Column:
    """The kind of work: from the title, else the first line that names one; a title of modernization decides how it is worded."""
    found = F.coalesce(Q.caught(title, P.WORK_TYPE), first_of(F.transform(lines, lambda x: Q.caught(x["text"], P.WORK_TYPE))))
    work = Q.squeezed(found)
    modern = _no(F.upper(title).contains("MODERNIZATION"))
    worded = F.when(_no(F.upper(title).contains("SITE IMPROVEMENT")), "Modernization & Site Improvements").otherwise("Modernization")
    return F.when(found.isNotNull(), F.when(modern, worded).when(Q.is_capitals(work), title_case(work)).otherwise(work))


def district_address(client: Column, site: Column, provider: Column) -> Column:
    """The owner's address: on its known street, else the nearest to a line that names the district; never the site's or the provider's."""

    def candidate(x: Column) -> Column:
        below = at(x["i"] + 1)
        town = F.when(_no(below["zip"]), F.concat(x["text"], F.lit(", "), below["text"])).otherwise(x["text"])
        c = F.coalesce(two_lines(x), F.when(x["one"] | (x["zip"] & x["text"].rlike(r"^\d{1,6}\s+")), x["text"]), F.when(x["street"] & x["up"].contains("CONCORD"), town))
        same = lambda other: _no(fingerprint(c) == fingerprint(other))
        return F.when(~same(site) & ~same(provider) & ~_no(site.isNotNull() & F.upper(c).contains("PACIFICA")), tidy(c))

    word = F.upper(F.get(Q.words(client), F.lit(0)))
    owner = lambda x: x["up"].contains("SCHOOL DISTRICT") | (_no(x["up"].contains(word)) & x["district"])
    offsets = F.sequence(F.lit(0), F.lit(DISTRICT_REACH))
    # Below before above at each distance; where the document ends below, the search of that line ends too.
    near = lambda x: first_of(F.transform(F.filter(offsets, lambda o: x["i"] + o < F.size(L)), lambda o: F.coalesce(candidate(at(x["i"] + o)), F.when(x["i"] - o >= 0, candidate(at(x["i"] - o))))))
    known = first_of(F.transform(F.filter(L, lambda x: x["up"].contains("CARLOTTA")), candidate))
    return F.coalesce(known, first_of(F.transform(F.filter(L, owner), near)))


def site_addresses(site: Column, district: Column, provider: Column) -> Column:
    """Array of the sites' addresses: the site, then others that are neither the district's nor the provider's nor a suite's; distinct, four at most."""
    others = F.filter(F.transform(L, site_candidate), lambda c: c.isNotNull() & ~Q.has(c, r"\bSUITE\b") & ~_no(fingerprint(c) == fingerprint(district)) & ~_no(fingerprint(c) == fingerprint(provider)))
    all_ = F.filter(F.concat(F.array(site), F.transform(others, tidy)), lambda c: c.isNotNull())
    keys = F.transform(all_, fingerprint)
    return F.slice(F.filter(all_, lambda c, i: F.array_position(keys, fingerprint(c)) == i + 1), 1, SITES_MOST)


def summary_bullets(lines: Column, most: int = 12) -> Column:
    """Array of the bullets of the project's summary: under its heading, or that speak of the plant anywhere; distinct, in order."""
    bare = lambda t: F.trim(F.regexp_replace(t, r"^[-•* ]+", ""))
    bullet = lambda t: t.rlike(r"^[-•*]")
    strong = lambda t: Q.has(bare(t), P.SUMMARY_STRONG)
    spoken = lambda t: (F.length(bare(t)) > 40) & Q.has(bare(t), P.SUMMARY_VERB)
    opens = lambda t: F.upper(t).contains("GENERAL SCOPE OF WORK INCLUDES") | F.upper(t).contains("PROJECT DESCRIPTION")
    closes = lambda t: (Q.has(t, P.SCOPE_HEADING) | F.upper(t).isin("CONSULTANTS", "REVISIONS", "SHEET INDEX")) & ~bullet(t) & ~strong(t) & ~spoken(t)
    events = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(opens(x["text"]), True).when(closes(x["text"]), False).alias("open"))), lambda e: e["open"].isNotNull())
    inside = lambda i: _no(F.try_element_at(F.filter(events, lambda e: e["i"] < i), F.lit(-1))["open"])
    kept = F.filter(lines, lambda x, i: ~opens(x["text"]) & (strong(x["text"]) | ((bullet(x["text"]) | spoken(x["text"])) & inside(i))))
    texts = F.filter(F.transform(kept, lambda x: bare(x["text"])), lambda t: F.length(t).between(28, 280) & ~Q.is_disclaimer(t) & ~Q.is_label(t) & ~Q.has(t, P.SUMMARY_NOT))
    keys = F.transform(texts, lambda t: F.upper(t))
    return F.slice(F.filter(texts, lambda t, i: F.array_position(keys, F.upper(t)) == i + 1), 1, most)


# ---- firms by stamp and logo


def firm_by_stamp(phone: Column, fax: Column, address: Column) -> Column:
    """The firm whose stamp a phone, fax or street shows; null if none."""
    digits = lambda x: F.right(F.regexp_replace(F.coalesce(x, F.lit("")), r"\D+", ""), F.lit(7))
    found = F.lit(None).cast("string")
    for firm, (local, street) in P.STAMPS.items():
        found = F.coalesce(found, F.when((digits(phone) == local) | (digits(fax) == local) | F.lower(F.coalesce(address, F.lit(""))).contains(street), firm))
    return found


def firm_of_logo(lines: Column) -> Column:
    """The firm that an array of text lines of a logo names: the surest, then the shortest; a number and the word below it are one name."""
    clean = F.filter(F.transform(lines, lambda t: Q.squeezed(F.coalesce(t, F.lit("")))), lambda t: (t != "") & (F.length(t) <= 60) & ~F.exists(F.array(*map(F.lit, P.NO_LOGO)), lambda k: F.upper(t).contains(k)))
    number = lambda t: t.rlike(r"^\d{2,4}$")
    told = F.filter(F.transform(clean, lambda t: F.struct(t.alias("t"), Q.squeezed(Q.caught(t, P.LOGO_FIRM)).alias("firm"), F.upper(t).isin("ARCHITECT", "ARCHITECTS").alias("word"))), lambda x: x["firm"].isNotNull() | number(x["t"]) | x["word"])

    def weigh(x: Column, i: Column) -> Column:
        merged = number(x["t"]) & _no(F.get(told, i + 1)["word"] & F.get(told, i + 1)["firm"].isNull())
        text = F.when(x["firm"].isNotNull(), x["firm"]).when(merged, F.concat(x["t"], F.lit(" Architects"))).when(number(x["t"]), x["t"])
        score = F.when(x["firm"].isNotNull(), 5 + F.when(Q.has(text, r"\bARCHITECTS?\b"), 4).otherwise(0) + F.when(Q.has(text, r"^\d{2,4}\s*ARCHITECTS?$"), 6).otherwise(0) + F.when(Q.has(text, r"\bDESIGN\b"), 3).otherwise(0)).when(merged, 10).otherwise(2)
        return F.when(text.isNotNull(), F.struct((-score).alias("minus"), F.length(text).alias("n"), i.alias("i"), text.alias("text")))

    best = F.array_min(F.filter(F.transform(told, weigh), lambda x: x.isNotNull()))["text"]
    return F.when(Q.has(best, r"^\d{2,4}\s+ARCHITECTS?$"), F.concat(F.regexp_extract(best, r"^(\d+)", 1), F.lit(" Architects"))).otherwise(best)
