"""The registered queries in DuckDB's SQL.

Patterns without look-around are framed by the characters that may stand beside a match; closed forms are used where
texts are made by formulas.
"""

from __future__ import annotations

from ..operators import pseudonym as S
from ..schemas import CATEGORIES
from .samples import COMPANY_CASES, PERSON_CASES

W = r"\p{L}\p{N}_"
EMAIL = rf"(^|[^/@{W}])([{W}.+\-]+@[{W}\-]+(?:\.[{W}\-]+)+)([^.{W}]|$)"
IP = r"(^|[^\d.]|[^\d]\.)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})($|[^\d.]|\.[^\d]|\.$)"
PHONE = r"(^|\D)(\+\d{1,3}[\s\-.]?\(?\d{1,5}\)?[\s\-.]\d{3,5}[\s\-.]\d{4,5})($|\D)"
US = r"(^|\D)((?:\(\d{3}\)|\d{3})[\s\-.]\d{3}[\s\-.]\d{4})($|\D)"
CARD = r"(^|\D)((?:\d[ \-]?){13,19}\d)($|\D)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def marked(pattern: str, table: str, key: str, text: str = "text", where: str = "true") -> str:
    """Spans with offsets: matches are put between marks, the text is split there and lengths are summed up."""
    return f"""
WITH cut AS (
  SELECT {key}, string_split_regex(regexp_replace({text}, {lit(pattern)}, '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '[\\x01\\x02]') AS p
  FROM {table}),
places AS (SELECT {key}, p, unnest(range(2, len(p), 2)) AS i FROM cut),
found AS (
  SELECT {key}, p[i] AS found, CAST(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS BIGINT) AS start_char FROM places)
SELECT {key}, found, start_char, start_char + length(found) AS end_char FROM found WHERE {where}
"""


OCTETS = "list_aggregate(list_transform(string_split(found, '.'), lambda x: CAST(x AS INTEGER)), 'max') <= 255"
EMAILS = marked(EMAIL, "documents", "doc_id")
IPS = marked(IP, "documents", "doc_id", where=OCTETS)
PHONES = marked(PHONE, "documents", "doc_id")
#: A blank behind a long run of digits is doubled, so that two cards that one blank parts are both framed.
CARDS = rf"""
SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(\d{{14,}}) ', '\1  ', 'g'), {lit(CARD)}, 2)) AS found FROM documents
"""
DIGITS = "regexp_replace(found, '[ -]', '', 'g')"


def luhn(digits: str) -> str:
    """Whether the sum of digits, every second from the right doubled, ends in zero."""
    double = "CASE WHEN (length(d) - i) % 2 = 1 THEN CAST(d[i] AS INTEGER) * 2 ELSE CAST(d[i] AS INTEGER) END"
    return f"(SELECT sum(v // 10 + v % 10) % 10 = 0 FROM (SELECT {double} AS v FROM (SELECT d, unnest(range(1, length(d) + 1)) AS i FROM (SELECT {digits} AS d))))"


LUHN = f"SELECT doc_id, found FROM ({CARDS}) c WHERE length({DIGITS}) BETWEEN 13 AND 19 AND {luhn(DIGITS)}"
PHONE_BOTH = f"""
WITH a AS ({PHONES}), b AS ({marked(US, "documents", "doc_id")})
SELECT * FROM a UNION ALL
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND (a.start_char <= b.start_char AND b.start_char < a.end_char OR a.start_char < b.end_char AND b.end_char <= a.end_char))
"""
#: All categories that the documents hold; after resolution none of these spans overlap.
STRUCTURED = f"""
SELECT doc_id, 'EMAIL' AS category, found FROM ({EMAILS}) UNION ALL
SELECT doc_id, 'IP', found FROM ({IPS}) UNION ALL
SELECT doc_id, 'PHONE', found FROM ({PHONE_BOTH}) UNION ALL
SELECT doc_id, 'CREDIT_CARD', found FROM ({LUHN})
"""

SSN = """
WITH t AS (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 5 END AS start_char,
    lpad(CAST(1 + c_custkey % 665 AS VARCHAR), 3, '0') || '-' || lpad(CAST(1 + c_custkey % 99 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 9999 AS VARCHAR), 4, '0') AS found
  FROM customer WHERE c_custkey % 7 <> 0)
"""
BIRTH = """
WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 9 END AS start_char,
    CASE (o_orderkey // 2) % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 2 THEN strftime(o_orderdate, '%B %d, %Y') ELSE strftime(o_orderdate, '%d %B %Y') END AS found
  FROM orders)
SELECT o_orderkey, found, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(found) AS BIGINT) AS end_char FROM t
"""
ADDRESS = """
WITH t AS (
  SELECT s_suppkey, 'Old note. Plot ' || s_suppkey || repeat('x', CASE WHEN s_suppkey % 2 = 0 THEN 20 ELSE 80 END) || ', Sector 5, ' || n_name || ' ' || lpad(CAST(100000 + s_suppkey AS VARCHAR), 6, '0') || '; end' AS text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
signals AS (
  SELECT s_suppkey, 10 AS s, 14 AS e, 2 AS kind FROM t UNION ALL
  SELECT s_suppkey, position('Sector' IN text) - 1, position('Sector' IN text) + 5, 2 FROM t UNION ALL
  SELECT s_suppkey, position('; end' IN text) - 7, position('; end' IN text) - 1, 4 FROM t),
flagged AS (SELECT *, CASE WHEN s - lag(e) OVER w > 60 THEN 1 ELSE 0 END AS fresh FROM signals WINDOW w AS (PARTITION BY s_suppkey ORDER BY s)),
sessions AS (SELECT *, sum(fresh) OVER (PARTITION BY s_suppkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS session FROM flagged)
"""
#: The fold over overlapping matches: `kept` is the last survivor after each match, `added` tells whether it is new.
RESOLVED = """
WITH RECURSIVE m AS (
  SELECT l_orderkey AS block, (l_linenumber * 7 + l_partkey) % 23 AS s, (l_linenumber * 7 + l_partkey) % 23 + 2 + l_partkey % 9 AS e,
    (l_suppkey % 10) / 10 AS conf, l_partkey % 3 AS rk, l_linenumber AS seq, l_suppkey % 3 AS cat FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY s, e, seq) AS n FROM m),
f AS (
  SELECT block, n, s, e, conf, rk, seq, cat, true AS added FROM o WHERE n = 1
  UNION ALL
  SELECT o.block, o.n,
    CASE WHEN c.take THEN o.s ELSE f.s END, CASE WHEN c.take THEN o.e ELSE f.e END, CASE WHEN c.take THEN o.conf ELSE f.conf END,
    CASE WHEN c.take THEN o.rk ELSE f.rk END, CASE WHEN c.take THEN o.seq ELSE f.seq END, CASE WHEN c.take THEN o.cat ELSE f.cat END, c.clear
  FROM f JOIN o ON o.block = f.block AND o.n = f.n + 1,
    LATERAL (SELECT NOT (f.s < o.e AND o.s < f.e) AS clear) AS d,
    LATERAL (SELECT d.clear, d.clear OR (-o.rk, o.e - o.s, o.conf) > (-f.rk, f.e - f.s, f.conf) AS take) AS c),
g AS (SELECT *, lead(added) OVER (PARTITION BY block ORDER BY n) AS next_added FROM f)
SELECT block, CAST(s AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char, CAST(seq AS BIGINT) AS seq FROM g WHERE coalesce(next_added, true)
"""

VALUES_SQL = """
SELECT DISTINCT ['EMAIL', 'PHONE', 'SSN', 'CREDIT_CARD', 'DOB', 'IP', 'PERSON', 'COMPANY', 'ADDRESS', 'PASSPORT'][c_custkey % 10 + 1] AS category,
  CASE c_custkey % 10 WHEN 1 THEN ['+91 98765 ', '+44 20 7946 ', '555 123 '][c_custkey % 3 + 1] || lpad(CAST(c_custkey AS VARCHAR), 5, '0')
    WHEN 4 THEN ['1985-03-15', '15/03/1985', '15-03-1985', '15.03.1985', 'March 15, 1985', '15/03/85'][c_custkey % 6 + 1] ELSE c_name END AS text
FROM customer
"""


def fakes(values: str) -> str:
    """(text, category, fake) of rows (text, category), by the same MD5 arithmetic."""
    items = lambda xs: "[" + ", ".join(map(lit, xs)) + "]"
    pick = lambda xs, n: f"{items(xs)}[{n} % {len(xs)} + 1]"
    pad = lambda n, width: f"lpad(CAST({n} % {10**width} AS VARCHAR), {width}, '0')"
    hexes = ", ".join(f"CAST(('0x' || substr(d, {8 * i + 1}, 8)) AS UBIGINT)::BIGINT AS n{i}" for i in range(4))
    area = "CASE WHEN n0 % 898 + 1 >= 666 THEN n0 % 898 + 2 ELSE n0 % 898 + 1 END"
    day = f"(DATE {lit(S.REFERENCE_DATE)} - CAST({S.YOUNGEST * 366} + n0 % {(S.OLDEST - S.YOUNGEST) * 365} AS INTEGER))"
    check = f"(SELECT min(c) FROM range(10) AS r(c) WHERE {luhn('body || CAST(c AS VARCHAR)')})"
    return f"""
WITH v AS ({values}),
h AS (SELECT *, md5('{S.SEED}|' || category || '|' || text) AS d FROM v),
n AS (SELECT *, {hexes} FROM h),
b AS (SELECT *, '4' || {pad("n0", 7)} || {pad("n1", 7)} AS body, regexp_replace(text, '[\\s\\-()]', '', 'g') AS bare FROM n)
SELECT text, category, CASE category
  WHEN 'EMAIL' THEN lower({pick(S.FIRST_NAMES, "n0")}) || '.' || lower({pick(S.LAST_NAMES, "n1")}) || CAST(n2 % 100 AS VARCHAR) || '@' || {pick(S.DOMAINS, "n3")}
  WHEN 'PHONE' THEN CASE
    WHEN bare LIKE '+91%' THEN '+91 ' || CAST(n0 % 4 + 6 AS VARCHAR) || substr({pad("n1", 9)}, 1, 4) || ' ' || substr({pad("n1", 9)}, 5, 5)
    WHEN bare LIKE '+%' THEN regexp_extract(text, '^(\\+\\d{{1,3}})', 1) || ' ' || {pad("n0", 4)} || ' ' || {pad("n1", 4)}
    ELSE '(' || {pad("n0", 3)} || ') ' || {pad("n1", 3)} || '-' || {pad("n2", 4)} END
  WHEN 'SSN' THEN {pad(f"({area})", 3)} || '-' || {pad("(n1 % 99 + 1)", 2)} || '-' || {pad("(n2 % 9999 + 1)", 4)}
  WHEN 'CREDIT_CARD' THEN body || CAST({check} AS VARCHAR)
  WHEN 'DOB' THEN CASE
    WHEN regexp_matches(text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN strftime({day}, '%Y-%m-%d')
    WHEN regexp_matches(text, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN strftime({day}, '%d/%m/%Y')
    WHEN regexp_matches(text, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN strftime({day}, '%d-%m-%Y')
    WHEN regexp_matches(text, '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') THEN strftime({day}, '%d.%m.%Y')
    WHEN regexp_matches(text, '[A-Za-z]') THEN strftime({day}, '%B %d, %Y') ELSE strftime({day}, '%d/%m/%Y') END
  WHEN 'IP' THEN {pick(S.NETWORKS, "n0")} || '.' || CAST(n1 % 254 + 1 AS VARCHAR)
  WHEN 'PERSON' THEN {pick(S.FIRST_NAMES, "n0")} || ' ' || {pick(S.LAST_NAMES, "n1")}
  WHEN 'COMPANY' THEN {pick(S.LAST_NAMES, "n1")} || ' ' || {pick(S.COMPANY_ENDS, "n0")}
  WHEN 'ADDRESS' THEN CAST(n0 % 999 + 1 AS VARCHAR) || ' ' || {pick(S.STREETS, "n1")} || ', ' || {pick(S.CITIES, "n2")}
  ELSE '[REDACTED_' || category || ']' END AS fake
FROM b
"""


MADE = """
WITH det AS (
  SELECT c_custkey AS id, 'name ' || (c_custkey % 200) AS norm,
    ['PERSON', 'EMAIL', 'PHONE', 'COMPANY', 'ADDRESS', 'SSN', 'CREDIT_CARD', 'DOB', 'IP'][c_custkey % 9 + 1] AS category, c_custkey % 7 AS para FROM customer),
gt AS (SELECT * FROM det WHERE id % 10 <> 0 UNION ALL SELECT id + 10000000, 'missing ' || id, category, para FROM det WHERE id % 13 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY category, norm, para ORDER BY id) AS k FROM det),
g AS (SELECT *, row_number() OVER (PARTITION BY category, norm, para ORDER BY id) AS k FROM gt),
pairs AS (SELECT d.id AS det_id, g.id AS gt_id, d.category FROM d JOIN g USING (category, norm, para, k)),
names AS (SELECT unnest({categories}) AS category),
counts AS (
  SELECT category, (SELECT count(*) FROM gt WHERE gt.category = names.category) AS gt, (SELECT count(*) FROM det WHERE det.category = names.category) AS detected,
    (SELECT count(*) FROM pairs WHERE pairs.category = names.category) AS tp FROM names)
""".format(categories="[" + ", ".join(map(lit, CATEGORIES)) + "]")


def scores(group: str, source: str = "counts") -> str:
    return f"""
SELECT category, gt, detected, tp, detected - tp AS fp, gt - tp AS fn, round(tp / nullif(detected, 0), 6) AS precision, round(tp / nullif(gt, 0), 6) AS recall,
  round(2 * (tp / nullif(detected, 0)) * (tp / nullif(gt, 0)) / nullif(tp / nullif(detected, 0) + tp / nullif(gt, 0), 0), 6) AS f1
FROM (SELECT {group} AS category, CAST(sum(gt) AS BIGINT) AS gt, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(tp) AS BIGINT) AS tp FROM {source} GROUP BY ALL)
"""


SCORES = MADE + scores("category", "(SELECT * FROM counts UNION ALL SELECT 'OVERALL', gt, detected, tp FROM counts)")
SHOWN = f"""
SELECT category, coalesce(format('{{:.3f}}', precision), 'N/A') AS precision, coalesce(format('{{:.3f}}', recall), 'N/A') AS recall,
  CASE WHEN precision IS NULL THEN '—' WHEN precision >= 0.8 THEN '✓' ELSE '✗' END AS precision_target,
  CASE WHEN recall IS NULL THEN '—' WHEN recall >= 0.85 THEN '✓' ELSE '✗' END AS recall_target
FROM ({SCORES})
"""


def rows(values: list[tuple], columns: str) -> str:
    sql = lambda v: ("true" if v else "false") if isinstance(v, bool) else lit(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, v)) + ')' for v in values)}) AS t({columns})"


#: Texts with a match of most kinds, and what is found in them.
KNOWN = """
WITH k AS (
  SELECT c_custkey AS doc_id, ['Limited', 'Foundation', 'Group'][c_custkey % 3 + 1] AS kind, 'u' || c_custkey || '@ex.org' AS mail,
    CASE WHEN c_custkey % 2 = 0 THEN '+91 ' ELSE '' END AS code, '98765' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS phone, '10.0.' || (c_custkey % 256) || '.7' AS ip FROM customer),
t AS (SELECT *, 'Signed by Asha Rao for Blue Metals ' || kind || ', mail ' || mail || ', call ' || code || phone || ', from ' || ip || '. DOB: 15/03/1985.' AS text FROM k),
f AS (
  SELECT doc_id, text, 'Asha Rao' AS found, 'PERSON' AS category, 0.9 AS confidence, 'ner' AS detector FROM t UNION ALL
  SELECT doc_id, text, 'Blue Metals ' || kind, 'COMPANY', CASE kind WHEN 'Limited' THEN 0.9 ELSE 0.85 END, 'ner' FROM t WHERE kind <> 'Group' UNION ALL
  SELECT doc_id, text, mail, 'EMAIL', 1.0, 'regex' FROM t UNION ALL
  SELECT doc_id, text, phone, 'PHONE', 1.0, 'regex' FROM t UNION ALL
  SELECT doc_id, text, ip, 'IP', 1.0, 'regex' FROM t UNION ALL
  SELECT doc_id, text, '15/03/1985', 'DOB', 0.9, 'regex' FROM t),
p AS (SELECT *, position(found IN text) - 1 AS start_char FROM f)
"""

LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents"
#: Lines with other than white space.
SEEN = r"regexp_matches({}, '[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]')"

ORACLES: dict[str, str] = {
    "blocks_nonempty": f"SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({LINES}) WHERE {SEEN.format('line')} GROUP BY doc_id",
    "blocks_by_lang": f"SELECT lang, count(*) AS n_blocks FROM documents WHERE {SEEN.format('text')} GROUP BY lang",
    "conversation_blocks": f"SELECT role, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE {SEEN.format('text')} GROUP BY role",
    "block_prefix_offsets": f"""
SELECT doc_id, i AS run_idx, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
FROM (SELECT doc_id, i, length(line) + CASE WHEN i < max(i) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS n_chars FROM ({LINES}))""",
    "docx_blocks": f"SELECT doc_id, count(*) AS n_blocks, max(i) AS last_idx, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({LINES}) WHERE {SEEN.format('line')} GROUP BY doc_id",
    "email_spans": EMAILS,
    "ip_spans": IPS,
    "phone_international": PHONES,
    "phone_us": marked(US, "documents", "doc_id"),
    "phone_priority": PHONE_BOTH,
    "card_candidates": CARDS,
    "card_luhn": LUHN,
    "pages_email_counts": f"SELECT page_id, count(*) AS n_emails FROM ({marked(EMAIL, 'pages', 'page_id', 'html')}) GROUP BY page_id",
    "ssn_spans": SSN + "SELECT c_custkey, found, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + 11 AS BIGINT) AS end_char FROM t",
    "ssn_confidence": SSN + "SELECT CAST(CASE WHEN start_char = 0 THEN 0.8 ELSE 0.95 END AS DOUBLE) AS confidence, count(*) AS n FROM t GROUP BY 1",
    "date_candidates": BIRTH,
    "dob_spans": f"SELECT * FROM ({BIRTH}) WHERE o_orderkey % 2 = 0",
    "validate_persons": rows(PERSON_CASES, "raw, preceding, accepted, confidence, needs_review, reason, category"),
    "validate_companies": rows(COMPANY_CASES, "raw, accepted, confidence, needs_review, reason"),
    "company_reasons": """
SELECT CASE c_custkey % 5 WHEN 0 THEN 'company_suffix' WHEN 1 THEN 'no_positive_evidence' WHEN 2 THEN 'act_regulation_name' WHEN 3 THEN 'no_positive_evidence' ELSE 'no_positive_evidence' END AS reason, count(*) AS n
FROM customer GROUP BY 1""",
    "address_clusters": ADDRESS + "SELECT s_suppkey, CAST(min(s) AS BIGINT) AS start_char, CAST(max(e) AS BIGINT) AS end_char, count(DISTINCT kind) AS n_kinds FROM sessions GROUP BY s_suppkey, session",
    "address_spans": ADDRESS + "SELECT s_suppkey, text[11:position('; end' IN text) - 1] AS found, CAST(10 AS BIGINT) AS start_char, position('; end' IN text) - 1 AS end_char FROM t",
    "resolve_overlaps": RESOLVED,
    "category_filter_after_resolve": RESOLVED + " AND cat = 1",
    "structured_counts": f"SELECT lang, category, count(*) AS n FROM ({STRUCTURED}) s JOIN documents USING (doc_id) GROUP BY ALL",
    "occurrence_counts": f"SELECT category, count(*) AS n FROM ({STRUCTURED}) GROUP BY category",
    "category_rollup": f"""
SELECT coalesce(lang, 'ALL') AS lang, coalesce(category, 'ALL') AS category, count(*) AS n
FROM ({STRUCTURED}) s JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, category)""",
    "category_share": f"SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({STRUCTURED}) GROUP BY category",
    "quality_join": f"SELECT quality, toxic, category, count(*) AS n FROM ({STRUCTURED}) s JOIN labels USING (doc_id) GROUP BY ALL",
    "pseudonym_map": fakes(VALUES_SQL),
    "pseudonym_compat": fakes("SELECT text, arg_min(category, o_orderkey) AS category FROM (SELECT 'text ' || o_custkey AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'PERSON' ELSE 'COMPANY' END AS category, o_orderkey FROM orders) GROUP BY text"),
    "redacted_emails": f"""
WITH e AS ({EMAILS}),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) AS k, lag(end_char, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_char) AS before FROM e),
m AS ({fakes("SELECT DISTINCT found AS text, 'EMAIL' AS category FROM e")}),
y AS (SELECT x.doc_id, string_agg(substr(d.text, x.before + 1, x.start_char - x.before) || m.fake, '' ORDER BY k) AS head, max(end_char) AS last FROM x JOIN m ON m.text = x.found JOIN documents d ON d.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT d.doc_id, md5(CASE WHEN y.doc_id IS NULL THEN d.text ELSE y.head || substr(d.text, y.last + 1) END) AS new_md5
FROM documents d LEFT JOIN y ON y.doc_id = d.doc_id WHERE {SEEN.format("d.text")}""",
    "redacted_runs": """
SELECT c_custkey, i AS run_idx, CASE i WHEN 0 THEN 'Pay Jane' WHEN 1 THEN '' ELSE ' now' END AS new_text FROM customer, range(3) AS r(i)""",
    "made_entities": KNOWN + """
SELECT doc_id, 'Asha Rao' AS found, 'PERSON' AS label, CAST(10 AS BIGINT) AS start_char, 'signed by' AS preceding FROM t UNION ALL
SELECT doc_id, 'Blue Metals ' || kind, 'ORG', CAST(23 AS BIGINT), 'signed by asha rao for' FROM t""",
    "made_detections_of_all_kinds": KNOWN + "SELECT doc_id, found, category, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(found) AS BIGINT) AS end_char, CAST(confidence AS DOUBLE) AS confidence, false AS needs_review, detector FROM p",
    "made_redaction": KNOWN + f""",
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) AS k, lag(start_char + length(found), 1, 0) OVER (PARTITION BY doc_id ORDER BY start_char) AS before FROM p),
m AS ({fakes("SELECT DISTINCT found AS text, category FROM f")})
SELECT x.doc_id, count(*) AS n_matches, string_agg(substr(x.text, x.before + 1, x.start_char - x.before) || m.fake, '' ORDER BY k) || substr(any_value(x.text), CAST(max(x.start_char + length(x.found)) AS BIGINT) + 1) AS new_text
FROM x JOIN m ON m.text = x.found AND m.category = x.category GROUP BY x.doc_id""",
    "phone_ten_digits": KNOWN + "SELECT doc_id, found, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + 10 AS BIGINT) AS end_char FROM p WHERE category = 'PHONE'",
    "address_hull": """
SELECT s_suppkey, CAST(n AS BIGINT) AS found, CAST(5 AS BIGINT) AS start_char, CAST(5 + n AS BIGINT) AS end_char
FROM (SELECT s_suppkey, CASE WHEN 290 + s_suppkey % 20 > 300 THEN 11 ELSE 290 + s_suppkey % 20 END AS n FROM supplier)""",
    "docx_tables": """
SELECT s_suppkey, 'paragraph' AS type, CAST(0 AS BIGINT) AS para_idx, CAST(-1 AS BIGINT) AS table_idx, CAST(-1 AS BIGINT) AS row_idx, CAST(-1 AS BIGINT) AS col_idx, CAST(-1 AS BIGINT) AS section_idx, 'Dear ' || s_name AS text FROM supplier
UNION ALL SELECT s_suppkey, 'table_cell', 0, 0, 0, 0, -1, 'Key' FROM supplier
UNION ALL SELECT s_suppkey, 'table_cell', 0, 0, 0, 1, -1, CAST(s_suppkey AS VARCHAR) FROM supplier
UNION ALL SELECT s_suppkey, 'table_cell', 0, 0, 1, 1, -1, s_name FROM supplier
UNION ALL SELECT s_suppkey, 'header', 0, -1, -1, -1, 0, 'Page of ' || s_name FROM supplier""",
    "score_within_tolerance": "SELECT 'PERSON' AS category, c_custkey AS det_id, c_custkey AS truth_id FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 21 <= 10",
    "score_detections": SCORES,
    "score_greedy": SCORES,
    "fp_rows": MADE + "SELECT category, count(*) AS n, min(id) AS first_id FROM det WHERE id NOT IN (SELECT det_id FROM pairs) GROUP BY category",
    "fn_rows": MADE + "SELECT category, count(*) AS n, min(id) AS first_id FROM gt WHERE id NOT IN (SELECT gt_id FROM pairs) GROUP BY category",
    "detector_metrics": MADE + scores("CASE WHEN category IN ('PERSON', 'COMPANY', 'ADDRESS') THEN 'NER' ELSE category END"),
    "coverage": MADE + "SELECT category, gt, detected, round(detected / nullif(gt, 0), 6) AS ratio FROM counts",
    "formatted_metrics": SHOWN,
    "top_k_examples": MADE + """
SELECT id, category, CASE WHEN id >= 10000000 THEN 'missing ' || (id - 10000000) ELSE ' name ' || (id % 200) || ' ' END AS text, rank
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rank FROM gt WHERE id NOT IN (SELECT gt_id FROM pairs)) WHERE rank <= 10""",
    "truth_candidates": """
SELECT 'Real Name ' || c_custkey AS text, ['PERSON', 'EMAIL', 'PHONE', 'COMPANY', 'ADDRESS', 'SSN', 'CREDIT_CARD', 'DOB', 'IP'][c_custkey % 9 + 1] AS category,
  CAST(c_custkey % 7 AS INTEGER) AS para_idx, CAST(c_custkey % 100 AS INTEGER) AS start_char, CAST(c_custkey % 100 + 10 + length(CAST(c_custkey AS VARCHAR)) AS INTEGER) AS end_char,
  'Independently verified candidate' AS notes
FROM customer WHERE c_custkey % 4 = 3""",
    "distinct_categories": "SELECT DISTINCT 'PASSPORT' AS category FROM customer WHERE c_custkey % 10 = 9",
    "stream_redaction": f"SELECT doc_id, count(*) AS n_matches FROM ({STRUCTURED}) GROUP BY doc_id",
}
