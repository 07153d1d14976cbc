"""SQL equivalents, for an independent engine, of the queries that SQL can express."""

from __future__ import annotations

from planloom.llm.canonical import STEPS, UNMATCHED
from planloom.llm.disciplines import other_names

_ACCENTS = "translate({x}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def _plain(x: str) -> str:
    """Lower case without accents, letter spacing and outer white space."""
    one = f"trim(replace({x}, chr(160), ' '))"
    joined = rf"replace(replace(regexp_replace({one}, '\s{{2,}}', chr(1), 'g'), ' ', ''), chr(1), ' ')"
    return _ACCENTS.format(x=rf"lower(CASE WHEN regexp_matches({one}, '^(?:\S\s+){{2,}}\S$') THEN {joined} ELSE {one} END)")


def _words(x: str) -> str:
    t = f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    bare = rf"trim(regexp_replace({t}, '(?:\s+consultants?)+$|^(?:consultants?\s+)+', '', 'g'))"
    return f"CASE WHEN regexp_matches({bare}, '^consultants?$') THEN {t} ELSE {bare} END"


def _ranked(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), '')"


def p4_sql() -> str:
    """Every typed discipline against every name: the closest within the edits allowed, words as typed before words in another order, then the smaller code."""
    names = ", ".join("('" + canonical.replace("'", "''") + "', '" + other.replace("'", "''") + "')" for canonical, other in other_names())
    allowed = "CASE " + " ".join(f"WHEN length(r.key) >= {least} THEN {edits}" for least, edits in sorted(STEPS, reverse=True)) + " ELSE 0 END"
    cleaned = r"regexp_replace(regexp_replace(p, '^(?:consultant|discipline|sub|trade)\s*[:\-]+\s*', ''), '\s*(?:#\s*[0-9]+|\(\s*sub\s*\)|-\s*of record|[:*])\s*$', '')"
    turned = r"regexp_replace(c, '^(.*?)\s*(?:,|\s-|\()\s*(.*)$', '\2 \1')"
    return f"""WITH e AS (SELECT doc_id, unnest(consultants) AS c, generate_subscripts(consultants, 1)::INT AS consultant_no FROM requirement), typed AS (SELECT doc_id, consultant_no, c.discipline AS v FROM e WHERE trim(replace(c.discipline, chr(160), ' ')) <> ''),
named AS (SELECT discipline_code AS code, discipline_name AS name FROM discipline_ref UNION SELECT discipline_code, o.other FROM discipline_ref JOIN (VALUES {names}) o(canonical, other) ON o.canonical = discipline_name),
rw AS (SELECT code, trim(regexp_replace({_plain('name')}, '[^a-z0-9]+', ' ', 'g')) AS w FROM named), refs AS (SELECT DISTINCT code, 'typed' AS ord, replace(w, ' ', '') AS key FROM rw UNION SELECT DISTINCT code, 'ranked', {_ranked('w')} FROM rw),
d AS (SELECT DISTINCT v, {_plain('v')} AS p FROM typed), cl AS (SELECT v, {cleaned} AS c FROM d), w AS (SELECT v, {_words('c')} AS a, {_words(turned)} AS b FROM cl),
k AS (SELECT v, 'typed' AS ord, 0 AS rank, replace(a, ' ', '') AS key FROM w UNION ALL SELECT v, 'typed', 1, replace(b, ' ', '') FROM w UNION ALL SELECT v, 'ranked', 2, {_ranked('a')} FROM w),
m AS (SELECT k.v, levenshtein(k.key, r.key) AS distance, k.rank, r.code FROM k JOIN refs r ON r.ord = k.ord AND abs(length(k.key) - length(r.key)) <= 2 WHERE k.key <> '' AND levenshtein(k.key, r.key) <= {allowed}),
best AS (SELECT v, code FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY distance, rank, code) AS rn FROM m) WHERE rn = 1)
SELECT doc_id, consultant_no, coalesce(code, '{UNMATCHED}') AS discipline_code FROM typed LEFT JOIN best USING (v)"""
