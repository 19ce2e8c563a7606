"""SQL of queries whose statement is long: sections, chunks, bills. Patterns are written out, as the library's are checked against them."""

from __future__ import annotations

_BLANKS = r"[ \t\n\x0b\f\r]+"

INDIAN_DIGITS = r"""SELECT vec_id, CASE WHEN monetary_cap < 0 THEN '-' ELSE '' END || CASE WHEN length(d) <= 3 THEN d
  ELSE ltrim(reverse(regexp_replace(reverse(left(d, length(d) - 3)), '(\d\d)', '\1,', 'g')), ',') || ',' || right(d, 3) END AS cap
  FROM (SELECT vec_id, monetary_cap, CAST(abs(monetary_cap) AS VARCHAR) AS d FROM rebuild_embeddings WHERE monetary_cap IS NOT NULL)"""

CLAUSE_BLOCKS = r"""SELECT policy_id, string_agg(l, chr(10) || chr(10) ORDER BY vec_id) AS block FROM (SELECT policy_id, vec_id, concat_ws(chr(10),
  '[' || row_number() OVER (PARTITION BY policy_id ORDER BY vec_id) || '] ' || coalesce(clause_title, ''),
  CASE WHEN waiting_period_days <> 0 THEN 'waiting_period_days: ' || waiting_period_days END, CASE WHEN monetary_cap <> 0 THEN 'monetary_cap: ' || monetary_cap END,
  CASE WHEN percent_cap <> 0 THEN 'percent_cap: ' || percent_cap END, clause_text) AS l FROM rebuild_embeddings) GROUP BY policy_id"""

# --- numbers wedged between words

_NUMERIC = (
    "rs inr rupees day days month months year years hour hours week weeks percent per cent lakh lakhs lac lacs crore crores age aged upto up to of than least "
    "maximum minimum section clause code excl exel list annexure point points times sum insured no number sl sr item within after before period plan option type "
    "level band and or the a an is are was were shall consecutive st nd rd th first second third pre next last only such these any all each"
)


def wedged(rows: str) -> str:
    """rows with w, the numbers of one to three digits between two words of its column t, a text with its blanks collapsed.
    The text falls into runs of letters, of digits and of anything else; a number counts by the runs around it."""
    near = ", ".join(f"'{w}'" for w in _NUMERIC.split())
    number = "regexp_matches(k[i], '^[0-9]{1,3}$') AND regexp_matches(k[i - 2], '^[A-Za-z]') AND NOT contains(k[i - 1], '_') AND right(k[i - 1], 1) NOT IN ('/', '.', '-') AND k[i + 1] = ' ' AND regexp_matches(k[i + 2], '^[A-Za-z]')"
    plain = f"lower(k[i - 2]) NOT IN ({near}) AND lower(k[i + 2]) NOT IN ({near})"
    w = f"list_transform(list_filter(range(3, len(k) - 1), lambda i: {number} AND {plain}), lambda i: CAST(k[i] AS BIGINT))"
    return f"SELECT * EXCLUDE (k), {w} AS w FROM (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+') AS k FROM ({rows}))"


# --- sections and chunks

_PAGES = "SELECT source_file AS doc, source_page AS page, string_agg(clause_text, chr(10) ORDER BY line, finding_id) AS text FROM numeric_audit_findings WHERE clause_text IS NOT NULL GROUP BY source_file, source_page"
_HEADINGS = [
    (r"\bPREAMBLE\b", "preamble"), (r"\bOPERATIVE\s+CLAUSE\b", "operative"), (r"\bSTANDARD\s+DEFINITIONS\b", "definition"), (r"\bSPECIFIC\s+DEFINITIONS\b", "definition"),
    (r"\bDEFINITIONS\b", "definition"), (r"\bCOVERAGE\b", "coverage"), (r"\bBENEFITS?\s+COVERED\b", "coverage"), (r"\bSTANDARD\s+EXCLUSIONS\b", "exclusion"),
    (r"\bSPECIFIC\s+EXCLUSIONS\b", "exclusion"), (r"\bEXCLUSIONS\b", "exclusion"), (r"\bWAITING\s+PERIODS?\b", "waiting_period"), (r"\bSTANDARD\s+CONDITIONS\b", "condition"),
    (r"\bSPECIFIC\s+CONDITIONS\b", "condition"), (r"\bGENERAL\s+CONDITIONS\b", "condition"), (r"\bCONDITIONS\b", "condition"), (r"\bTABLE\s+OF\s+BENEFITS\b", "benefits_table"),
    (r"\bANNEXURE\s*[-–]?\s*A\b", "annexure"), (r"\bLIST\s+OF\s+INSURANCE\s+OMBUDSMAN\b", "ombudsman"), (r"\bGRIEVANCE\s+REDRESSAL\b", "ombudsman"),
]


def _labelled() -> str:
    count = lambda p: f"len(regexp_extract_all(text, '{p}', 0, 'i'))"
    cases = " ".join(f"WHEN regexp_matches(x, '{p}', 'i') AND (length(regexp_extract(x, '{p}', 0, 'i')) > 0.35 * length(trim(x)) OR x = upper(x)) THEN '{label}'" for p, label in _HEADINGS)
    first = f"list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) > 0 AND length(l) <= 90), lambda x: CASE {cases} END), lambda s: s IS NOT NULL)[1]"
    excl, means, wait = r"\bExcl\s*\.?\s*-?\s*\d{1,2}\b", r"\bmeans\b", r"\bwaiting\s+period\b"
    return f"SELECT doc, page, text, CASE WHEN {count(excl)} >= 2 THEN 'exclusion' WHEN {count(means)} >= 3 THEN 'definition' WHEN {count(wait)} >= 2 THEN 'waiting_period' ELSE {first} END AS label FROM ({_PAGES})"


def _sectioned() -> str:
    return f"SELECT doc, page, text, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS section FROM ({_labelled()})"


def sections() -> str:
    return f"SELECT doc, page, section FROM ({_sectioned()})"


def _borders(overlap: int, most: int = 6000) -> str:
    """Borders by recursion over a document's pages: held is what the chunk holds so far, in characters."""
    mark = "length('[[page ' || page || ']]') + 1"
    tail = f"CASE WHEN length(text) <= {overlap} THEN text WHEN strpos(left(right(text, {overlap}), 200), chr(10)) > 0 THEN substring(right(text, {overlap}), strpos(left(right(text, {overlap}), 200), chr(10)) + 1) ELSE right(text, {overlap}) END" if overlap else "''"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS rn, length(text) AS size, {mark} AS mark, {tail} AS tail FROM ({_sectioned()}) WHERE regexp_replace(text, '{_BLANKS}', '', 'g') <> ''),
    b AS (SELECT doc, rn, page, section, 0 AS chunk, CAST(NULL AS BIGINT) AS opens, size + mark AS held, length(tail) + mark AS carry FROM p WHERE rn = 1
      UNION ALL SELECT p.doc, p.rn, p.page, p.section, b.chunk + CAST(p.section <> b.section OR b.held + p.size > {most} AS INT), CASE WHEN {overlap} > 0 AND p.section = b.section AND b.held + p.size > {most} THEN b.page END,
      CASE WHEN p.section = b.section AND b.held + p.size <= {most} THEN b.held WHEN {overlap} > 0 AND p.section = b.section THEN b.carry ELSE 0 END + p.size + p.mark, length(p.tail) + p.mark FROM b JOIN p ON p.doc = b.doc AND p.rn = b.rn + 1),
    pieces AS (SELECT b.doc, b.chunk, b.section, 1 AS k, b.page, p.text FROM b JOIN p USING (doc, page) UNION ALL SELECT b.doc, b.chunk, b.section, 0, b.opens, p.tail FROM b JOIN p ON b.doc = p.doc AND b.opens = p.page),
    c AS (SELECT doc, chunk, any_value(section) AS section, regexp_replace(string_agg('[[page ' || page || ']]' || chr(10) || text, chr(10) ORDER BY k, page), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g') AS text, arg_min(page, (k, page)) AS start_page, arg_max(page, (k, page)) AS end_page FROM pieces GROUP BY doc, chunk)"""


def chunks() -> str:
    return _borders(1500) + " SELECT doc, chunk, section, text, start_page, end_page FROM c"


def boundaries() -> str:
    body = "regexp_replace(regexp_replace(regexp_replace(text, '\\[\\[page \\d+\\]\\]', '', 'g'), '[ \\t]+', ' ', 'g'), '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')"
    return _borders(0) + f""", n AS (SELECT doc, chunk, section, {body} AS body, lead(section) OVER (PARTITION BY doc ORDER BY chunk) AS next FROM c),
    d AS (SELECT *, coalesce(next = section, false) AS within, length(regexp_replace(body, '(?s)^.*[.!?][ \\t\\n\\x0b\\f\\r]', '')) AS back, coalesce(next = section, false) AND body <> '' AND NOT regexp_matches(body, '[.!?]$') AS cut FROM n)
    SELECT doc, count(*) AS chunks, count(*) FILTER (WHERE within) AS boundaries, count(*) FILTER (WHERE cut) AS cut, count(*) FILTER (WHERE cut AND back <= 1500) AS recoverable, count(*) FILTER (WHERE cut AND back > 1500) AS lost FROM d GROUP BY doc"""


# --- bills

_STOP = (
    "'CHARGES', 'CHARGE', 'EXPENSES', 'EXPENSE', 'COST', 'COSTS', 'FEE', 'FEES', 'AND', 'OR', 'THE', 'OF', 'FOR', 'PER', 'IN', 'ON', 'TO', 'A', 'AN', 'WITH', 'ANY', 'ALL', 'ITEM', 'ITEMS', 'MISC', 'OTHER', 'OTHERS', "
    "'USED', 'DURING', 'IF', 'NOT', 'NO', 'ROOM', 'LONG', 'SHORT', 'SMALL', 'LARGE', 'MEDIUM', 'EXTRA'"
)
_AMOUNT = r"(?:(?:RS|INR|₹)\.?\s*)?(\d[\d,]*(?:\.\d{1,2})?)\s*$"


def _upper(x: str) -> str:
    return f"trim(regexp_replace(upper(coalesce({x}, '')), '{_BLANKS}', ' ', 'g'))"


def _telling(x: str) -> str:
    return f"list_filter(regexp_extract_all({_upper(x)}, '[A-Z]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"


def _lines() -> str:
    raw = r"SELECT doc_id AS bill, u.i AS line_no, trim(u.raw) AS raw FROM documents, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) WITH ORDINALITY AS u(raw, i) WHERE doc_kind = 'bill'"
    with_amount = f"SELECT *, regexp_extract(raw, '{_AMOUNT}', 1, 'i') AS a FROM ({raw}) WHERE length(raw) >= 3"
    body = rf"trim(regexp_replace(CASE WHEN a <> '' THEN regexp_replace(raw, '{_AMOUNT}', '', 'i') ELSE raw END, '^\s*\d{{1,3}}[.):]\s+', ''))"
    described = rf"SELECT bill, line_no, raw, regexp_replace({body}, '[\s.:;,|-]+$', '') AS description, CASE WHEN a <> '' THEN TRY_CAST(replace(a, ',', '') AS DOUBLE) END AS amount FROM ({with_amount})"
    return f"SELECT * FROM ({described}) WHERE len({_telling('description')}) > 0"


def bill_lines() -> str:
    return _lines()


def _matched() -> str:
    items = "SELECT item_name, category, min(category_description) AS category_description, min(rn) AS item FROM (SELECT *, row_number() OVER () AS rn FROM non_payable_items) WHERE item_name IS NOT NULL GROUP BY item_name, category"
    alts = r"SELECT i.*, u.alt, u.k FROM items i, unnest(list_filter(list_transform(string_split_regex(i.item_name, '\s*/\s*'), lambda a: trim(a, ' ,.;:-')), lambda a: a <> '')) WITH ORDINALITY AS u(alt, k)"
    scored = f"SELECT *, {_telling('alt')} AS needed, {_upper('alt')} AS whole FROM alts"
    words = f"list_filter(regexp_extract_all({_upper('description')}, '[A-Z]+'), lambda t: length(t) >= 2)"
    present = "len(list_filter(w.words, lambda t: t = n OR (length(n) >= 3 AND (starts_with(t, n) OR starts_with(n, t)) AND abs(length(t) - length(n)) <= 2))) > 0"
    hit = f"(len(a.needed) > 0 AND len(list_filter(a.needed, lambda n: NOT ({present}))) = 0) OR (len(a.needed) = 0 AND length(a.alt) >= 8 AND contains(w.up, a.whole))"
    score = "CASE WHEN len(a.needed) > 0 THEN list_sum(list_transform(a.needed, lambda t: length(t))) ELSE length(a.alt) END"
    return f"""WITH l AS MATERIALIZED ({_lines()}), items AS ({items}), alts AS ({alts}), s AS MATERIALIZED ({scored}), w AS MATERIALIZED (SELECT DISTINCT description, {words} AS words, {_upper('description')} AS up FROM l),
    h AS (SELECT w.description, a.item, a.item_name, a.alt AS matched_alternative, a.category, a.category_description, row_number() OVER (PARTITION BY w.description ORDER BY {score} DESC, a.item, a.k) AS r FROM w JOIN s a ON {hit}),
    m AS MATERIALIZED (SELECT l.*, h.item, h.item_name, h.matched_alternative, h.category, h.category_description FROM l LEFT JOIN h ON l.description = h.description AND h.r = 1)"""


def bill_matches() -> str:
    return _matched() + " SELECT bill, line_no, description, amount, item_name, matched_alternative, category FROM m WHERE item IS NOT NULL"


def bill_categories() -> str:
    return _matched() + " SELECT category, count(*) AS lines, coalesce(sum(amount), 0.0) AS amount, bool_and(amount IS NOT NULL) AS amount_known FROM m WHERE item IS NOT NULL GROUP BY category"


def bill_totals() -> str:
    return _matched() + """ SELECT *, round(flagged_total / nullif(bill_total, 0.0), 4) AS flagged_share FROM (SELECT bill, count(*) AS lines_read, count(*) FILTER (WHERE item IS NOT NULL) AS lines_flagged,
    count(*) FILTER (WHERE item IS NOT NULL AND amount IS NULL) AS without_amount, round(coalesce(sum(amount), 0.0), 2) AS bill_total, round(coalesce(sum(amount) FILTER (WHERE item IS NOT NULL), 0.0), 2) AS flagged_total FROM m GROUP BY bill)"""


def bill_findings() -> str:
    return _matched() + " SELECT bill, CAST(row_number() OVER (PARTITION BY bill ORDER BY category <> 'not_payable', coalesce(amount, 0.0) DESC, line_no) AS INT) AS rank, line_no, category, amount FROM m WHERE item IS NOT NULL"


def bill_charges() -> str:
    return _matched() + """ SELECT bill, CASE WHEN category = 'not_payable' THEN 'never' ELSE 'twice' END AS "group", category, count(*) AS lines, coalesce(sum(amount), 0.0) AS amount FROM m WHERE item IS NOT NULL GROUP BY ALL"""


def bill_letters() -> str:
    line = "line_no || '. ' || description || ': ' || coalesce(format('{:,.2f}', amount), 'amount not stated')"
    part = lambda head, where: f"CASE WHEN count(*) FILTER (WHERE {where}) > 0 THEN '{head}' || chr(10) || string_agg({line}, chr(10) ORDER BY line_no) FILTER (WHERE {where}) || chr(10) || 'Total: ' || format('{{:,.2f}}', coalesce(sum(amount) FILTER (WHERE {where}), 0.0)) END"
    never, twice = part("A. Never payable", "category = 'not_payable'"), part("B. Part of another charge", "category <> 'not_payable'")
    return _matched() + f" SELECT bill, concat_ws(chr(10) || chr(10), {never}, {twice}, 'Sum: ' || format('{{:,.2f}}', coalesce(sum(amount), 0.0))) AS letter FROM m WHERE item IS NOT NULL GROUP BY bill"
