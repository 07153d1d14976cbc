"""SQL equivalents, for an independent engine, of the queries in ``reference``."""

# Lines of documents: the same line breaks and white space as in the Spark functions.
_LINES = r"""
a AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'),
    lambda x: trim(regexp_replace(replace(x, chr(0), ''), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS l
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1)::INT AS line_no FROM a)
"""
_PHONE = r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
_DATE = r"\b([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s+[0-9]{4})\b"
_SHOWN = "CASE WHEN length({d}) = 10 THEN '(' || {d}[1:3] || ') ' || {d}[4:6] || '-' || {d}[7:10] ELSE trim({x}) END"
_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
# Sections with their items; a missing list counts as an empty one.
_SECTIONS = """
s AS (SELECT doc_id, unnest(scope_sections) AS x, generate_subscripts(scope_sections, 1)::INT AS section_no FROM requirement),
sections AS (SELECT doc_id, section_no, x.title AS title, coalesce(list_filter(x.items, lambda i: i IS NOT NULL), []) AS items FROM s)
"""
_RULES = "(count IS NULL OR (count BETWEEN 0 AND 100000)) AS count_ok, (unit_cost IS NULL OR (NOT isnan(unit_cost) AND unit_cost BETWEEN 0 AND 1e7)) AS cost_ok"
_DISTINCT_DETECTIONS = "SELECT doc_id, device_type, count(*) AS detected FROM (SELECT DISTINCT doc_id, page_number, device_type, confidence, detection, detected_at FROM detections) GROUP BY ALL"
_BLANK = "nullif(trim({x}, chr(9) || chr(10) || chr(13) || ' ' || chr(160)), '')"


def _first(*columns: str) -> str:
    return "coalesce(" + ", ".join(_BLANK.format(x=c) for c in columns) + ")"


def _ordered(rows: str, value: str, most: int) -> str:
    """First of each distinct entry in order, capped."""
    return f"""first AS (SELECT doc_id, upper({value}) AS k, min(line_no) AS o, arg_min({value}, line_no) AS v FROM {rows} GROUP BY ALL),
ranked AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS position FROM first)
SELECT doc_id, position::INT AS position, v AS entry FROM ranked WHERE position <= {most}"""


_JOB, _LICENSE, _STATE = r"\b([0-9]{4,6}\.[0-9]{2})\b", r"\b(C-[0-9]{4,6})\b", r"\b(0[0-9]-[0-9]{5,7})\b"
_STATUS = r"\b(CONSTRUCTION\s+DOCUMENTS?|BID\s+SET|FOR\s+BID|DSA\s+SUBMITTAL|ISSUED\s+FOR\s+[A-Z][A-Z\s]{2,40})\b"
_WORK = r"\b(ROOF\s+RESTORATION|ROOF\s+REPLACEMENT|MODERNIZATION(?:\s*&\s*SITE\s+IMPROVEMENTS?)?|SITE\s+IMPROVEMENTS?|INFRASTRUCTURE\s+UPGRADE|HVAC\s+REPLACEMENT)\b"


def _title(x: str) -> str:
    """Title case of words of letters between single blanks."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


def _sentence(x: str) -> str:
    return f"CASE WHEN length({x}) > 20 AND upper({x}) = {x} AND lower({x}) <> {x} THEN upper({x}[1:1]) || lower({x}[2:]) ELSE {x} END"


_LISTS = (("Project Summary", "project_summary"), ("Limits of Work", "limits_of_work"), ("Applicable Codes", "applicable_codes"), ("Bid Alternates", "alternates"), ("Notes", "notes"))

SQL = {
    "text_lines": f"WITH {_LINES} SELECT doc_id, line_no, text FROM lines",
    "page_stats": f"""WITH {_LINES}, n AS (SELECT doc_id, count(*) AS lines FROM lines GROUP BY doc_id)
SELECT d.doc_id, count(*) AS pages, count(*) FILTER (WHERE trim(d.text) <> '') AS pages_with_text, coalesce(any_value(n.lines), 0)::BIGINT AS lines FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "first_phone": f"""WITH {_LINES}, hits AS (SELECT doc_id, line_no, regexp_extract(text, '{_PHONE}') AS x FROM lines WHERE regexp_matches(text, '{_PHONE}')),
one AS (SELECT doc_id, arg_min(x, line_no) AS x FROM hits GROUP BY doc_id), n AS (SELECT doc_id, x, {_DIGITS.format(x="x")} AS d FROM one)
SELECT doc_id, {_SHOWN.format(d="d", x="x")} AS phone FROM n""",
    "sheet_index": rf"""WITH {_LINES}, t AS (SELECT *, regexp_extract(text, '^SHT\s+([0-9]+)\s*[-–]\s*(.+)$', ['n', 't'], 'i') AS m,
  regexp_extract(text, '^([0-9]?[A-Z]{{1,3}}-?[0-9]{{2,3}}[A-Z]?)\s+([A-Z][A-Z0-9\s/&.,''-]{{3,60}})$', ['n', 't'], 'i') AS c FROM lines WHERE length(text) <= 90),
e AS (SELECT doc_id, line_no, CASE WHEN m.n <> '' THEN 'SHT ' || m.n || ' — ' || trim(m.t)
  WHEN c.n <> '' AND len(regexp_split_to_array(trim(c.t), '\s+')) >= 2 AND NOT regexp_matches(c.t, '\b(ABBREVIATION|SYMBOL|LEGEND|NORTH|PENNY|POUND)\b', 'i') THEN upper(c.n) || ' — ' || trim(c.t) END AS entry FROM t),
found AS (SELECT * FROM e WHERE entry IS NOT NULL), {_ordered("found", "entry", 40)}""",
    "alternates": rf"""WITH {_LINES}, t AS (SELECT doc_id, line_no, regexp_replace(text, '^[0-9]+\.\s+', '') AS x, regexp_extract(regexp_replace(text, '^[0-9]+\.\s+', ''), '^(?:BID\s+)?ALTERNATE\s*(?:NO\.?\s*)?#?\s*([A-Z0-9]+)(?:\s*[-–—:]\s*(.+))?$', ['n', 't'], 'i') AS m FROM lines),
named AS (SELECT doc_id, line_no, 'Alternate ' || upper(m.n) || CASE WHEN trim(m.t) <> '' THEN ' — ' || trim(m.t) ELSE '' END AS entry FROM t WHERE m.n <> '' AND length(m.n) <= 6 AND upper(m.n) <> 'ALT' AND NOT regexp_matches(x, '\b(MATERIALS?|DESIGNS?|METHODS?\s+OF\s+CONSTRUCTION|WASTE\s+REDUCTION|ALUMINUM|ABBREVIATION|WORKING\s+WITH\s+LOCAL)\b', 'i')),
found AS (SELECT * FROM named WHERE length(entry) <= 160), {_ordered("found", "entry", 10)}""",
    "numbered_items": rf"""WITH {_LINES}, t AS (SELECT doc_id, line_no, text, regexp_extract(text, '^([0-9]+)\.(?:\s+|$)(.*)$', ['n', 't']) AS m, regexp_matches(text, '^(Regards|Thanks),?$', 'i') AS ends FROM lines),
i AS (SELECT *, sum(CASE WHEN m.n <> '' THEN 1 ELSE 0 END) OVER w AS island FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
o AS (SELECT *, max(CASE WHEN ends AND m.n = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS ended FROM i WHERE island > 0)
SELECT doc_id, island::INT AS item_no, max(try_cast(nullif(m.n, '') AS INT)) AS number,
  coalesce(string_agg(CASE WHEN m.n <> '' THEN nullif(m.t, '') ELSE text END, ' ' ORDER BY line_no), '') AS text FROM o WHERE ended = 0 GROUP BY doc_id, island""",
    "next_line_pairs": rf"""WITH {_LINES}, t AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS follower FROM lines)
SELECT doc_id, line_no, text, follower FROM t WHERE regexp_matches(text, '^(NAME|TEL|MAIL) ', 'i') AND follower IS NOT NULL""",
    "bounded_scan": rf"""WITH {_LINES}, a2 AS (SELECT doc_id, line_no AS anchor_no FROM lines WHERE regexp_matches(text, '^SCOPE OF WORK', 'i')),
w AS (SELECT doc_id, line_no, text FROM lines WHERE regexp_matches(text, 'job [0-9]{{5}}', 'i'))
SELECT a2.doc_id, anchor_no, min(line_no) AS found_no, arg_min(text, line_no) AS text FROM a2 JOIN w ON w.doc_id = a2.doc_id AND line_no BETWEEN anchor_no - 2 AND anchor_no + 19 AND line_no <> anchor_no GROUP BY ALL""",
    "near_anchor": rf"""WITH {_LINES}, anchors AS (SELECT doc_id, min(line_no) AS k FROM lines WHERE regexp_matches(text, 'job [0-9]{{5}}', 'i') GROUP BY doc_id),
s AS (SELECT l.doc_id, text, line_no, coalesce(greatest(0, 15 - abs(line_no - k)), 0) AS score FROM lines l LEFT JOIN anchors USING (doc_id) WHERE regexp_matches(text, '{_DATE}', 'i')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rn FROM s)
SELECT doc_id, text AS value, line_no, score::INT AS score FROM r WHERE rn = 1""",
    "best_heading": rf"""WITH {_LINES}, s AS (SELECT *, CASE WHEN regexp_matches(upper(text), 'SCHOOL|DISTRICT') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(upper(text), 'JOB NUMBER|[0-9]{{5}}\.[0-9]{{2}}') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(upper(text), 'SHEET INDEX|DRAWING INDEX') THEN 4 ELSE 0 END + CASE WHEN contains(upper(text), 'ADDENDUM') THEN 3 ELSE 0 END + CASE WHEN contains(upper(text), 'SCOPE OF WORK') THEN 5 ELSE 0 END
  + CASE WHEN length(text) > 80 THEN -5 ELSE 0 END AS score FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rn FROM s WHERE score >= 1)
SELECT doc_id, text AS value, line_no, score::INT AS score FROM r WHERE rn = 1""",
    "scope_segments": rf"""WITH {_LINES}, t AS (SELECT *, CASE WHEN regexp_matches(text, '^(SCOPE OF WORK|GENERAL NOTES|NOTAS GENERALES|NOTES GÉNÉRALES):?$', 'i') THEN 1 ELSE 0 END AS h FROM lines),
g AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY line_no) - 1 AS k FROM g WHERE seg > 0)
SELECT doc_id, seg::INT AS segment_no, max(CASE WHEN h = 1 THEN text END) AS title, count(*) FILTER (WHERE h = 0)::INT AS body_lines, coalesce(string_agg(CASE WHEN h = 0 THEN text END, chr(10) ORDER BY line_no), '') AS body FROM n WHERE k <= 90 GROUP BY doc_id, seg""",
    "captured_lines": rf"""WITH {_LINES}, t AS (SELECT *, CASE WHEN regexp_matches(text, '^(GENERAL NOTES|SCOPE OF WORK):?$', 'i') THEN 1 WHEN regexp_matches(text, '^(REGARDS|THANKS|ADDENDUM NO|RE: job|Minutes of)', 'i') THEN 0 END AS flag FROM lines),
s AS (SELECT *, last_value(flag IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS state FROM t) SELECT doc_id, line_no, text FROM s WHERE state = 1 AND flag IS NULL""",
    "section_overlap": rf"""WITH {_SECTIONS}, k AS (SELECT doc_id, section_no, list_distinct(list_filter(list_transform(items, lambda i: upper(trim(regexp_replace(i, '\s+', ' ', 'g')))[1:96]), lambda i: i <> '')) AS keys FROM sections)
SELECT * FROM (SELECT a.doc_id, a.section_no, b.section_no AS other_no, round(CASE WHEN len(a.keys) > 0 AND len(b.keys) > 0 THEN len(list_intersect(a.keys, b.keys)) / least(len(a.keys), len(b.keys)) ELSE 0.0 END, 6) AS shared FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.section_no > a.section_no) WHERE shared > 0""",
    "metadata_merged": f"""SELECT id, {_first("p.title", "r.project_title")} AS title, {_first("p.client", "r.client")} AS client, {_first("p.architect", "r.provider_company")} AS architect, {_first("p.engineer", "r.consultants[1].firm")} AS engineer,
  {_first("p.project_address", "r.site_address")} AS project_address FROM projects p LEFT JOIN requirement r ON r.doc_id = p.id""",
    "provider_summary": f"SELECT doc_id, nullif(concat_ws(' · ', {', '.join(_BLANK.format(x=c) for c in ('provider_company', 'provider_agent', 'provider_phone', 'provider_address'))}), '') AS summary FROM requirement",
    "provider_phones": f"""WITH n AS (SELECT doc_id, provider_phone AS x, provider_address AS y, {_DIGITS.format(x="provider_phone")} AS d FROM requirement WHERE provider_phone IS NOT NULL), l AS (SELECT *, CASE WHEN length(d) = 11 AND d[1] = '1' THEN d[2:] ELSE d END AS e FROM n)
SELECT doc_id, CASE WHEN length(e) >= 7 THEN e END AS digits, {_SHOWN.format(d="d", x="x")} AS shown, regexp_replace(upper(y), '[^A-Z0-9]', '', 'g') AS address_key FROM l""",
    "projects_recent": "SELECT id, strftime(created_at, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m') ORDER BY created_at DESC, id)::INT AS newest_no FROM projects",
    "file_names": r"WITH b AS (SELECT id, regexp_replace(regexp_replace(filename, '^.*[/\\]', ''), '^(.+)\.[^.]*$', '\1') AS s FROM projects) SELECT id, s || ' requirement.pdf' AS pdf_name, s || '_report.csv' AS csv_name FROM b",
    "report_fields": " UNION ALL ".join(f"SELECT id, {i} AS seq, '{label}' AS field, coalesce({c}, '') AS information FROM projects" for i, (label, c) in enumerate((("Project Title", "title"), ("Client", "client"), ("Architect", "architect"), ("Engineer", "engineer"), ("Project Address", "project_address"), ("Due Date", "due_date")), 1)),
    "device_counts": _DISTINCT_DETECTIONS,
    "device_names": "WITH c AS (SELECT device_type, count(*) AS rows FROM detections GROUP BY ALL) SELECT c.device_type, c.rows, coalesce(r.display_name, array_to_string(list_transform(string_split(c.device_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS display_name, r.device_type IS NULL AS missing FROM c LEFT JOIN rates r ON r.device_type = c.device_type",
    "best_detections": "WITH r AS (SELECT doc_id, page_number, device_type, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, page_number, device_type) AS rn FROM detections WHERE confidence IS NOT NULL) SELECT doc_id, page_number, device_type, confidence FROM r WHERE rn = 1",
    "clamped_boxes": """WITH b AS (SELECT doc_id, trunc(greatest(0, least(detection.box.x1, 1000)))::BIGINT AS x1, trunc(greatest(0, least(detection.box.y1, 800)))::BIGINT AS y1, trunc(greatest(0, least(detection.box.x2, 1000)))::BIGINT AS x2, trunc(greatest(0, least(detection.box.y2, 800)))::BIGINT AS y2
  FROM detections WHERE detection.score >= 0.5) SELECT doc_id, count(*) AS boxes, sum(x2 - x1)::BIGINT AS widths, sum(y2 - y1)::BIGINT AS heights FROM b GROUP BY doc_id""",
    "class_scores": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, round(1 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS share FROM embeddings",
    "override_rejects": f"WITH o AS (SELECT DISTINCT line_id, count, unit_cost, changed_at FROM overrides), r AS (SELECT *, {_RULES} FROM o) SELECT line_id, changed_at, concat_ws(',', CASE WHEN NOT count_ok THEN 'count' END, CASE WHEN NOT cost_ok THEN 'unit_cost' END) AS broken FROM r WHERE NOT (count_ok AND cost_ok)",
    "lines_changed": f"""WITH r AS (SELECT *, {_RULES} FROM overrides), v AS (SELECT line_id, count, row_number() OVER (PARTITION BY line_id ORDER BY changed_at DESC, count DESC) AS rn FROM r WHERE count_ok AND cost_ok AND count IS NOT NULL)
SELECT l.id, l.project_id, l.device_type, coalesce(v.count, l.count) AS count, l.detected_count FROM device_lines l LEFT JOIN v ON v.line_id = l.id AND v.rn = 1""",
    "lines_left": "SELECT id, project_id, device_type FROM device_lines WHERE project_id NOT IN (SELECT id FROM projects WHERE status = 'failed')",
    "lines_replaced": f"SELECT project_id, device_type, detected_count FROM device_lines UNION ALL SELECT doc_id, device_type, detected::INT FROM ({_DISTINCT_DETECTIONS}) WHERE doc_id NOT IN (SELECT project_id FROM device_lines)",
    "consultants_distinct": f"""WITH c AS (SELECT doc_id, unnest(consultants) AS c, generate_subscripts(consultants, 1) AS line_no FROM requirement),
named AS (SELECT doc_id, line_no, trim(c.discipline) || ' — ' || trim(c.firm) AS entry FROM c WHERE trim(c.discipline) <> '' AND trim(c.firm) <> ''), {_ordered("named", "entry", 12)}""",
    "cleaned_titles": rf"""WITH t AS (SELECT doc_id, client, trim(regexp_replace(project_title, '\s+', ' ', 'g')) AS x FROM requirement), u AS (SELECT doc_id, client, {_sentence("x")} AS y FROM t WHERE x <> '')
SELECT doc_id, CASE WHEN length(y) > 40 THEN rtrim(y[1:39]) || '…' ELSE y END AS title, coalesce({_BLANK.format(x="client")}, 'Not found in drawing') AS client FROM u""",
    "report_sections": "WITH p AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{h}' AS heading, list_filter(coalesce({c}, []), lambda i: {_BLANK.format(x='i')} IS NOT NULL) AS items FROM requirement" for i, (h, c) in enumerate(_LISTS))
    + f"""), q AS (SELECT doc_id, heading, items, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INT AS section_no FROM p WHERE len(items) > 0),
r AS (SELECT doc_id, section_no, heading, generate_subscripts(items, 1)::INT AS seq, trim(unnest(items)) AS x FROM q) SELECT doc_id, section_no, heading, seq, {_sentence("x")} AS text FROM r""",
    "two_line_addresses": rf"""WITH {_LINES}, t AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS follower FROM lines),
e AS (SELECT doc_id, line_no, regexp_replace(text, '[\s,;]+$', '') || ', ' || follower AS entry FROM t WHERE regexp_matches(text, '^[0-9]{{1,6}}\s+[A-Z0-9][\w\s.,#''-]{{3,80}}$', 'i')
  AND regexp_matches(follower, '\b[A-Z]{{2}}\s+[0-9]{{5}}(?:-[0-9]{{4}})?\b', 'i') AND NOT regexp_matches(text, '\b[A-Z]{{2}}\s+[0-9]{{5}}(?:-[0-9]{{4}})?\b', 'i')),
first AS (SELECT doc_id, regexp_replace(upper(entry), '[^A-Z0-9]', '', 'g') AS k, min(line_no) AS o, arg_min(entry, line_no) AS v FROM e GROUP BY ALL), ranked AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS position FROM first)
SELECT doc_id, position::INT AS position, v AS entry FROM ranked WHERE position <= 4""",
    "header_fields": f"""WITH {_LINES}, t AS (SELECT doc_id, line_no, nullif(regexp_extract(text, '{_JOB}', 1), '') AS job, nullif(upper(regexp_extract(text, '{_LICENSE}', 1, 'i')), '') AS lic,
  CASE WHEN length(text) <= 60 AND len(regexp_extract_all(text, '{_STATE}')) <= 1 AND NOT regexp_matches(text, '\\((?:E)\\)|\\b(RAMP|RESTROOM|SOLAR|PLAYGROUND|PARKING|BUILDING|BLDG)\\b', 'i') THEN nullif(regexp_extract(text, '{_STATE}', 1), '') END AS num,
  nullif(regexp_extract(text, '{_PHONE}'), '') AS ph, nullif(regexp_extract(text, '{_STATUS}', 1, 'i'), '') AS st, nullif(regexp_replace(regexp_extract(text, '{_WORK}', 1, 'i'), '\\s+', ' ', 'g'), '') AS wt, nullif(regexp_extract(text, '{_DATE}', 1, 'i'), '') AS dt FROM lines),
f AS (SELECT doc_id, arg_min(job, line_no) FILTER (WHERE job IS NOT NULL) AS job_number, arg_min(lic, line_no) FILTER (WHERE lic IS NOT NULL) AS license, arg_min(num, line_no) FILTER (WHERE num IS NOT NULL) AS state_number,
  arg_min(ph, line_no) FILTER (WHERE ph IS NOT NULL) AS x, arg_min(st, line_no) FILTER (WHERE st IS NOT NULL) AS st, arg_min(wt, line_no) FILTER (WHERE wt IS NOT NULL) AS wt, arg_min(dt, line_no) FILTER (WHERE dt IS NOT NULL) AS date_text FROM t GROUP BY doc_id),
n AS (SELECT *, {_DIGITS.format(x="x")} AS d, upper(regexp_replace(st, '\\s+', ' ', 'g')) AS s FROM f)
SELECT doc_id, job_number, license, state_number, CASE WHEN x IS NOT NULL THEN {_SHOWN.format(d="d", x="x")} END AS phone,
  CASE WHEN contains(s, 'CONSTRUCTION DOCUMENT') THEN 'Construction Document' WHEN contains(s, 'BID SET') OR s = 'FOR BID' THEN 'Bid Set' WHEN contains(s, 'DSA SUBMITTAL') THEN 'DSA Submittal' ELSE {_title("trim(s)")} END AS status,
  {_title("wt")} AS work_type, date_text FROM n WHERE coalesce(job_number, license, state_number, x, st, wt, date_text) IS NOT NULL""",
    "report_json": "SELECT id, '{' || array_to_string(list_filter([" + ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || to_json({c}) END""" for c in ("id", "title", "client", "architect")) + "], lambda x: x IS NOT NULL), ',') || '}' AS report FROM projects",
    "stamp_firms": rf"""WITH n AS (SELECT doc_id, trim(provider_company) AS firm, lower(coalesce(provider_address, '')) AS y, {_DIGITS.format(x="provider_phone")} AS d FROM requirement), l AS (SELECT *, CASE WHEN length(d) = 11 AND d[1] = '1' THEN d[2:] ELSE d END AS e,
  regexp_extract(y, '\b([0-9]+)\s+(?:(?:north|south|east|west|[nsew])\b\.?\s+)?([a-z]{{3,}})', ['h', 's']) AS m FROM n),
r AS (SELECT doc_id, firm, unnest(list_filter([CASE WHEN length(e) >= 7 THEN right(e, 7) END, CASE WHEN m.h <> '' THEN m.h || ' ' || m.s END], lambda t: t IS NOT NULL)) AS token FROM l),
c AS (SELECT token, firm, count(*) AS k FROM r WHERE coalesce(upper(firm), '') NOT IN ('', 'N/A', 'TBD') GROUP BY ALL), best AS (SELECT token, firm, k FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY k DESC, firm DESC) AS rn FROM c) WHERE rn = 1)
SELECT doc_id, firm FROM (SELECT r.doc_id, best.firm, row_number() OVER (PARTITION BY r.doc_id ORDER BY k DESC, best.firm DESC) AS rn FROM r JOIN best USING (token) WHERE coalesce(upper(r.firm), '') IN ('', 'N/A', 'TBD')) WHERE rn = 1""",
}
