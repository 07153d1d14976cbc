"""SQL equivalents, for an independent engine, of the queries in ``extraction``. Patterns are the fixed values that the operators use too; fixtures check those."""

from __future__ import annotations

from planloom.operators import patterns as P
from planloom.operators.cleanup import FIELDS, LISTS
from planloom.operators.fields import CODE_NAME, LIMITS
from planloom.operators.lines import CELL_LABELS
from planloom.operators.pages import COVER_SIGNS, SCOPE_SIGN
from planloom.plans.reference_sql import _LINES, _SECTIONS, _ordered


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_quoted(pattern)}, 'i')"


def _like(x: str, pattern: str) -> str:
    """With regard to case."""
    return f"regexp_matches({x}, {_quoted(pattern)})"


def _in(x: str, values: tuple) -> str:
    return f"{x} IN ({', '.join(map(_quoted, values))})"


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _capitals(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') AND upper({x}) = {x})"


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def _letters(x: str) -> str:
    return rf"length(regexp_replace({x}, '\P{{L}}', '', 'g'))"


def _path(x: str) -> str:
    return rf"(contains({x}, '/') OR contains({x}, '\') OR starts_with(upper({x}), 'AUTODESK') OR starts_with(upper({x}), 'WWW.') OR {_like(f'upper({x})', P.FILE_NAME)})"


def _person(x: str) -> str:
    w = _words(x)
    return (
        f"(len({w}) BETWEEN 2 AND 3 AND len(list_filter({w}, lambda w: NOT {_like('w', '^[A-Za-z][A-Za-z.' + chr(39) + '-]*$')})) = 0 AND {_like(x, '[A-Za-z]{2}')} AND length({x}) BETWEEN 3 AND 40 "
        f"AND NOT ({_has(x, P.LABEL)} OR {_has(x, P.COMPANY)} OR {_has(x, P.DISTRICT)} OR {_has(x, P.NOT_A_NAME)} OR {_like(x, P.STANDALONE_PHONE)} OR {_like(x, P.ZIP_LINE)}) AND NOT {_in(f'upper({w}[-1])', ('ES', 'MS', 'HS', 'ES.', 'MS.', 'HS.'))})"
    )


def _generic(x: str) -> str:
    return _has(f"trim(regexp_replace(trim({x}), ':+$', ''))", P.GENERIC_TITLE)


def _heading(x: str) -> str:
    return f"({x} <> '' AND length({x}) < 80 AND NOT {_has(x, '^SHT' + chr(92) + 'b')} AND ({_has(x, P.NOTES_HEADING)} OR ({_has(x, P.SCOPE_HEADING)} AND NOT {_has(x, P.HEADING_SENTENCE)} AND ({_spaces(x)} <= 8 OR ends_with({x}, ':')))))"


def _chrome(x: str) -> str:
    party = f"({_like(x, P.STANDALONE_PHONE)} OR {_has(x, P.COMPANY)} OR {_has(x, P.DISTRICT)} OR {_has(x, P.STREET)})"
    return f"({x} = '' OR {_has(x, P.TITLE_BLOCK)} OR {_has(x, P.ONE_LINE_ADDRESS)} OR ({party} AND NOT {_has(x, P.WORK_VERB)}))"


def _schedule(x: str) -> str:
    return f"({x} = '' OR {_has(x, P.SCHEDULE)} OR (length({x}) <= 24 AND NOT {_like(x, P.NUMBERED)} AND ({_like(x, P.PART_NUMBER)} OR {_in(f'upper({x})', P.SCHEDULE_CELLS)})))"


def _sheets(x: str) -> str:
    codes = f"len(regexp_extract_all({x}, {_quoted(P.SHEET_CODE)}))"
    return f"({codes} >= 3 OR {_has(x, P.SHEETS_TOTAL)} OR ({_has(x, P.PLAN_WORDS)} AND {codes} >= 2))"


def _prose(x: str) -> str:
    noise = f"({_has(x, P.JUNK_ITEM)} OR {_chrome(x)} OR {_like(x, P.DIMENSION)} OR {_like(x, r'^[0-9.' + chr(92) + 'sA-Z/-]{1,20}$')})"
    return f"(length({x}) >= 28 AND {_like(x, '^[A-Za-z(]')} AND {_letters(x)} >= 18 AND {_letters(x)} > 0.45 * length({x}) AND NOT {noise} AND ({_has(x, P.WORK_VERB)} OR length({x}) > 60))"


def _quality(x: str) -> str:
    noise = f"({_has(x, P.JUNK_ITEM)} OR {_chrome(x)} OR {_schedule(x)} OR ({_like(x, P.DIMENSION)} AND length({x}) < 80) OR {_has(x, P.TECHNOLOGY_SHEET)})"
    return f"(length({x}) >= 20 AND NOT {noise} AND len(list_filter({_words(x)}, lambda w: {_like('w', '[A-Za-z]{3}')})) >= 3 AND ({_has(x, P.WORK_VERB)} OR length({x}) >= 50))"


def _points(x: str) -> str:
    return f"CASE WHEN {_has(x, P.WORK_VERB)} THEN 3 ELSE 0 END + CASE WHEN {_chrome(_squeezed(x))} THEN -5 ELSE 0 END + CASE WHEN length({x}) > 40 THEN 1 ELSE 0 END"


_BARE = "regexp_replace({x}, '^[ :.\\-]+|[ :.\\-]+$', '', 'g')"


def _cut(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN rtrim({x}[1:{most - 1}]) || '…' ELSE {x} END"


def _value(x: str, most: int, personish: bool = False, no_disclaimer: bool = False) -> str:
    t = _BARE.format(x=rf"regexp_replace({x}, '\s+', ' ', 'g')")
    bad = f"{t} = '' OR {_has(t, P.BAD_VALUE)} OR {_like(t, P.SPACED_LETTERS)}"
    if no_disclaimer:
        bad += f" OR {_has(t, P.REPORT_DISCLAIMER)}"
    if personish:
        bad += f" OR len({_words(t)}) > 4 OR {_has(t, P.NOT_PERSONISH)}"
    return f"CASE WHEN NOT ({bad}) THEN {_cut(t, most)} END"


def _field(name: str) -> str:
    t = _value(name, FIELDS[name], name == "provider_agent", name in ("client", "project_title"))
    if name == "job_number":
        return f"CASE WHEN NOT {_has(f'({t})', 'sheet|title|date')} THEN {t} END"
    if name == "dsa_number":
        return f"CASE WHEN {_like(f'({t})', '^0[0-9]-[0-9]{5,7}$')} THEN {t} END"
    return t


def _title_case(x: str) -> str:
    """Upper case after every character that is no letter."""
    c = f"string_split(lower({x}), '')"
    return f"array_to_string(list_transform({c}, lambda c, i: CASE WHEN i = 1 OR NOT regexp_matches(lower({x})[i - 1], '\\p{{L}}') THEN upper(c) ELSE c END), '')"


def _section_title(x: str) -> str:
    bare = f"regexp_replace({_BARE.format(x=_squeezed(x))}, '^SHT\\s+\\d+\\s*[-–]?\\s*', '', 'i')"
    return f"CASE WHEN {_capitals(bare)} AND length({bare}) > 4 THEN {_title_case(bare)} ELSE {bare} END"


def _item(x: str) -> str:
    bad = (
        f"length({x}) < 20 OR {_sheets(x)} OR ({_has(x, P.REPORT_DISCLAIMER)} AND length({x}) > 160) OR ({_has(x, P.REPORT_CHROME)} AND NOT {_has(x, P.REPORT_VERB)}) OR ({_has(x, P.REPORT_KEYNOTE)} AND {_letters(x)} < 40) "
        f"OR ({_has(x, P.CALLOUT)} AND {_like(x, P.CALLOUT_CODE)})"
    )
    return f"CASE WHEN NOT ({bad}) THEN CASE WHEN length({x}) > 500 THEN rtrim({x}[1:497]) || '…' ELSE {x} END END"


def _worth(x: str) -> str:
    up = f"upper({x})"
    return (
        f"(CASE WHEN {_generic(x)} THEN -2 WHEN contains({up}, 'SCOPE OF WORK') OR ends_with({up}, ' SCOPE') THEN 5 ELSE 0 END + CASE WHEN {_like(up, P.FIRST_TRADES)} THEN 8 ELSE 0 END + CASE WHEN {_like(up, P.OTHER_TRADES)} THEN 4 ELSE 0 END "
        f"+ CASE WHEN {_in(up, P.VAGUE_TITLES)} THEN -3 ELSE 0 END)"
    )


_KINDS = {
    "label": _has("text", P.LABEL), "disclaimer": _has("text", P.DISCLAIMER), "path": _path("text"), "person": _person("bare"), "heading": _heading("text"), "chrome": _chrome("text"), "schedule": _schedule("text"), "sheets": _sheets("text"),
    "prose": _prose("text"), "quality": _quality("text"),
}
_COVER = " + ".join(f"CASE WHEN {_like('upper(text)', sign.replace('[' + chr(92) + 's' + chr(92) + 'S]*', '(?s:.*)'))} THEN {weight} ELSE 0 END" for sign, weight in COVER_SIGNS)
_SECTION_ITEMS = "s AS (SELECT doc_id, unnest(scope_sections) AS x, generate_subscripts(scope_sections, 1)::INT AS section_no FROM requirement)"

SQL = {
    "line_kinds": f"WITH {_LINES}, b AS (SELECT text, {_BARE.format(x='text')} AS bare FROM lines), k AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _KINDS.items()) + f" FROM b) SELECT {', '.join(_KINDS)}, count(*) AS lines FROM k GROUP BY ALL",
    "page_gates": f"""WITH {_LINES}, j AS (SELECT doc_id, string_agg(upper(text), ' ' ORDER BY line_no) AS t FROM lines WHERE NOT {_has('text', CELL_LABELS)} GROUP BY doc_id),
g AS (SELECT d.doc_id, {_has('text', SCOPE_SIGN)} AS scope_page, {_has('text', P.TITLE_PAGE)} AND NOT (contains(upper(text), 'ABBREVIATIONS') AND contains(upper(text), 'DRAFTING ITEMS')) AS title_page,
  coalesce(contains(t, 'PROJECT OWNER') OR (contains(t, 'SCHOOL DISTRICT') AND contains(t, 'CONSULTANTS') AND NOT contains(t, 'AGENT:')), false) AS architect_set, ({_COVER})::INT AS cover_score FROM documents d LEFT JOIN j USING (doc_id) WHERE text IS NOT NULL)
SELECT * FROM g WHERE scope_page OR title_page OR architect_set OR cover_score <> 0""",
    "building_codes": f"""WITH {_LINES}, l AS (SELECT doc_id, line_no, CASE WHEN length(text) > 120 OR {_spaces('text')} > 18 THEN nullif(regexp_extract(text, {_quoted(f'({CODE_NAME}(?:' + chr(92) + 's*' + chr(92) + '([^)]{0,40}' + chr(92) + '))?)')}, 1, 'i'), '') ELSE text END AS x
  FROM lines WHERE {_has('text', P.BUILDING_CODE)} AND NOT {_has('text', P.DISCLAIMER)}), found AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(x, '^[ –-]+|[ –-]+$', '', 'g'), '^20[0-9]{{2}}\\s+', '') AS entry FROM l WHERE {_has('x', f'^(?:20[0-9]{{2}}' + chr(92) + f's+)?{CODE_NAME}' + chr(92) + 'b')}),
{_ordered("found", "entry", 8)}""",
    "limits_of_work": f"WITH {_LINES}, found AS (SELECT doc_id, line_no, text AS entry FROM lines WHERE {_has('text', LIMITS)} AND length(text) BETWEEN 8 AND 160 AND NOT {_has('text', P.DISCLAIMER)}), {_ordered('found', 'entry', 8)}",
    "report_values": "SELECT doc_id, " + ", ".join(f"{_field(f)} AS {f}" for f in FIELDS) + " FROM requirement",
    "report_lists": "WITH e AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS list_name, line_no, {_value('v', length)} AS entry, {most} AS most FROM (SELECT doc_id, unnest({n}) AS v, generate_subscripts({n}, 1) AS line_no FROM requirement)" for n, (length, most) in LISTS.items())
    + f"""), first AS (SELECT doc_id, list_name, most, upper(entry) AS k, min(line_no) AS o, arg_min(entry, line_no) AS entry FROM e WHERE entry IS NOT NULL AND NOT ({_has('entry', P.REPORT_DISCLAIMER)} AND length(entry) > 120) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, list_name ORDER BY o) AS position FROM first) SELECT doc_id, list_name, position::INT AS position, entry FROM r WHERE position <= most""",
    "report_consultants": f"""WITH c AS (SELECT doc_id, unnest(consultants) AS c, generate_subscripts(consultants, 1) AS line_no FROM requirement),
v AS (SELECT doc_id, line_no, {_value('c.discipline', 60)} AS discipline, {_value('c.firm', 80)} AS firm, {_value('c.phone', 40)} AS phone, {_value('c.address', 100)} AS address FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, upper(discipline), upper(firm) ORDER BY line_no) AS again FROM v WHERE discipline IS NOT NULL AND firm IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS position FROM f WHERE again = 1)
SELECT doc_id, position::INT AS position, discipline, firm, phone, address FROM r WHERE position <= 12""",
    "report_items": f"""WITH {_SECTION_ITEMS}, t AS (SELECT doc_id, section_no, {_section_title("coalesce(x.title, '')")} AS title, list_filter(list_transform(list_transform(coalesce(x.items, []), lambda y: {_squeezed('y')}), lambda y: {_item('y')}), lambda y: y IS NOT NULL) AS a FROM s),
u AS (SELECT *, {_in('upper(title)', P.VAGUE_TITLES)} AS vague, list_filter(a, lambda y: length(y) > 45 AND NOT {_like('y', P.CALLOUT_START)}) AS long FROM t), v AS (SELECT doc_id, section_no, title, CASE WHEN NOT vague THEN a WHEN len(long) >= 2 THEN long ELSE [] END AS items FROM u)
SELECT doc_id, section_no, title, {_worth('title')}::INT AS worth, generate_subscripts(items, 1)::INT AS item_no, unnest(items) AS text FROM v""",
    "projects_done": "SELECT id, filename, created_at FROM projects WHERE status = 'done'",
    "pages_cut": "SELECT doc_id, total_pages, least(total_pages, 8) AS pages_read, coalesce(total_pages > 8, false) AS truncated FROM requirement",
    "page_names": "SELECT DISTINCT doc_id, page_number, format('page_{:03d}.png', page_number) AS file_name FROM detections WHERE page_number <= 8",
    "lines_ordered": "SELECT id, project_id, device_type, row_number() OVER (PARTITION BY project_id ORDER BY device_type, id)::INT AS line_no FROM device_lines WHERE project_id IN (SELECT id FROM projects)",
    "project_details": """WITH c AS (SELECT project_id AS id, count(*) AS lines, sum(count)::BIGINT AS devices, count(*) FILTER (WHERE needs_review) AS to_review FROM device_lines GROUP BY ALL)
SELECT p.id, filename, status, title, client, coalesce(lines, 0) AS lines, coalesce(devices, 0) AS devices, coalesce(to_review, 0) AS to_review FROM projects p LEFT JOIN c USING (id)""",
    "identities_merged": """SELECT p.id, coalesce(CASE WHEN NOT regexp_matches(p.title, '^(PROJECT\\s+NAME|SCHOOL\\s+NAME|PROJECT\\s+TITLE|SHEET\\s+TITLE)\\b', 'i') AND trim(p.title) <> '' THEN p.title END,
  CASE WHEN NOT regexp_matches(r.project_title, '^(PROJECT\\s+NAME|SCHOOL\\s+NAME|PROJECT\\s+TITLE|SHEET\\s+TITLE)\\b', 'i') AND trim(r.project_title) <> '' THEN r.project_title END) AS title FROM projects p LEFT JOIN requirement r ON r.doc_id = p.id""",
}

# Queries of the module ``reference`` whose rules are these.
_SCORED = f"CASE WHEN len(items) = 0 THEN -1 ELSE list_sum(list_transform(items, lambda i: {_points('i')})) END"
SQL |= {
    "work_prose": f"WITH {_LINES} SELECT doc_id, line_no, {_letters('text')} / length(text) AS letters FROM lines WHERE {_prose('text')}",
    "section_scores": f"WITH {_SECTIONS} SELECT doc_id, section_no, title, len(items)::INT AS items, len(list_filter(list_transform(items, lambda i: {_squeezed('i')}), lambda i: {_quality('i')}))::INT AS kept, ({_SCORED})::INT AS score FROM sections",
    "top_sections": f"""WITH {_SECTIONS}, p AS (SELECT doc_id, section_no, ({_SCORED})::INT AS score FROM sections), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section_no) AS rank FROM p)
SELECT doc_id, rank::INT AS rank, section_no, score FROM r WHERE rank <= 8""",
}
_BULLET = r"trim(regexp_replace(text, '^[-•* ]+', ''))"
_EVENTS = rf"""t AS (SELECT doc_id, line_no, text, {_BULLET} AS bare, regexp_matches(text, '^[-•*]') AS bullet, {_has(_BULLET, P.SUMMARY_STRONG)} AS strong, length({_BULLET}) > 40 AND {_has(_BULLET, P.SUMMARY_VERB)} AS spoken,
  contains(upper(text), 'GENERAL SCOPE OF WORK INCLUDES') OR contains(upper(text), 'PROJECT DESCRIPTION') AS opens, {_has('text', P.SCOPE_HEADING)} OR upper(text) IN ('CONSULTANTS', 'REVISIONS', 'SHEET INDEX') AS closes FROM lines),
u AS (SELECT *, CASE WHEN opens THEN 1 WHEN closes AND NOT bullet AND NOT strong AND NOT spoken THEN 0 END AS event FROM t),
v AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM u)"""
SQL |= {
    "notes_found": f"""WITH {_LINES}, h AS (SELECT doc_id, min(line_no) AS heading_no FROM lines WHERE {_has('text', P.NOTES_HEADING)} GROUP BY doc_id), below AS (SELECT doc_id, line_no, text FROM lines JOIN h USING (doc_id) WHERE line_no > heading_no AND NOT {_has('text', P.NOTES_HEADING)}),
s AS (SELECT doc_id, min(line_no) AS stop FROM below WHERE {_heading('text')} OR {_has('text', P.LABEL)} GROUP BY doc_id),
k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS note_no FROM below LEFT JOIN s USING (doc_id) WHERE (stop IS NULL OR line_no < stop) AND length(text) > 20) SELECT doc_id, note_no::INT AS note_no, text FROM k WHERE note_no <= 15""",
    "summaries": f"""WITH {_LINES}, {_EVENTS}, found AS (SELECT doc_id, line_no, bare AS entry FROM v WHERE NOT opens AND (strong OR ((bullet OR spoken) AND coalesce(state, 0) = 1)) AND length(bare) BETWEEN 28 AND 280
  AND NOT {_has('bare', P.DISCLAIMER)} AND NOT {_has('bare', P.LABEL)} AND NOT {_has('bare', P.SUMMARY_NOT)}), {_ordered('found', 'entry', 12)}""",
}
