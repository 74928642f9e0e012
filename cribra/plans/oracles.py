"""DuckDB twins of the registered queries, over the same parquet tables.

The stand-in views are written once here as CTE text and shared; parameters
(signatures, split points, batch size) come from the same constants the
Spark side uses.
"""

from __future__ import annotations

from cribra.functions import text as TX
from cribra.functions.dates import MINUTES_PER_UNIT
from cribra.functions.geo import EARTH_RADIUS_KM, KM_PER_UNIT
from cribra.operators import extract as E
from cribra.operators import rules
from cribra.operators.predicates import _py_canonical
from cribra.operators.stats import PERCENTILES, SIZE_RANGES, TOP_N
from cribra.plans import catalog as C
from cribra.schemas import CRITERION_KINDS, ELIGIBILITY_JSON_PATH
from cribra.sources import standins as S


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _kind_case(col: str) -> str:
    padded = f"(' ' || lower({col}) || ' ')"
    arms = " ".join(
        f"WHEN regexp_matches({padded}, {_q('[^a-z](' + pat + ')')}) THEN {_q(kind)}"
        for kind, pat in rules.KIND_RULES)
    return f"CASE {arms} ELSE {_q(rules.FALLBACK_KIND)} END"


NCT = "'NCT' || lpad(CAST({0} AS VARCHAR), greatest(8, length(CAST({0} AS VARCHAR)))::INTEGER, '0')"

BRONZE_DOCS = f"""bronze_docs AS (
  SELECT {NCT.format('doc_id')} AS nct_id, doc_id, text AS eligibility, lang, source, n_chars
  FROM documents)"""


def _rule_criteria_cte(src: str = "bronze_docs", name: str = "rule_criteria") -> str:
    h = _q(rules.HEADING_RE)
    return f"""{name}_s AS (
  SELECT nct_id, string_split_regex(eligibility, {h}) AS chunks,
         regexp_extract_all(eligibility, {h}, 1) AS heads
  FROM {src}),
{name}_c AS (
  SELECT nct_id, heads, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS k FROM {name}_s),
{name}_b AS (
  SELECT nct_id, heads, k, CASE WHEN k < n THEN regexp_replace(chunk, {_q(rules.QUALIFIER_RE)}, '')
                               ELSE chunk END AS chunk
  FROM (SELECT *, len(chunks) AS n FROM {name}_c JOIN (SELECT nct_id AS _id, chunks FROM {name}_s) ON _id = nct_id)),
{name}_l AS (
  SELECT nct_id, k,
         CASE WHEN k > 1 THEN lower(heads[k - 1]) = 'exclusion' ELSE false END AS is_exclusion,
         unnest(string_split(chunk, chr(10))) AS line,
         generate_subscripts(string_split(chunk, chr(10)), 1) AS j
  FROM {name}_b),
{name}_r AS (
  SELECT nct_id, is_exclusion,
         regexp_replace(regexp_replace(line, {_q(rules.BULLET_RE)}, ''), {_q(rules.TRAIL_RE)}, '') AS text,
         CAST(row_number() OVER (PARTITION BY nct_id ORDER BY k, j) - 1 AS INTEGER) AS ordinal
  FROM {name}_l WHERE regexp_matches(line, '\\S')),
{name} AS (
  SELECT nct_id, ordinal,
         CASE WHEN is_exclusion THEN 'exc-' ELSE 'inc-' END || CAST(ordinal AS VARCHAR) AS criterion_id,
         text, {_kind_case('text')} AS kind, is_exclusion
  FROM {name}_r)"""


RULE_CRITERIA = _rule_criteria_cte()

ORACLES: dict[str, str] = {}

ORACLES["rule_criteria"] = f"""WITH {BRONZE_DOCS}, {RULE_CRITERIA}
SELECT nct_id, ordinal, criterion_id, text, kind, is_exclusion FROM rule_criteria"""

ORACLES["kind_distribution"] = f"""WITH {BRONZE_DOCS}, {RULE_CRITERIA},
k AS (SELECT kind, count(*) AS criteria FROM rule_criteria GROUP BY kind)
SELECT kind, criteria, CAST(criteria AS DOUBLE) / CAST(sum(criteria) OVER () AS DOUBLE) AS share FROM k"""


# ---- shared stand-in views ---------------------------------------------------------

SIG = _q(S.CURRENT_SIGNATURE)
LEGACY = _q(S.LEGACY_SIGNATURE)
SPLIT = f"TIMESTAMP {_q(S.SPLIT_TS)}"
HAS_TEXT = "coalesce(regexp_matches({}, '\\S'), false)"
THROTTLED = "coalesce({}, '') LIKE '%429%'"

UPDATES = f"""updates AS (
  SELECT {NCT.format('user_id')} AS nct_id, event_id AS seq, ts, CAST(ts AS DATE) AS last_update_posted,
         props AS raw, event_type AS status FROM events)"""


def _latest(name: str, where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY seq DESC) AS rn FROM updates WHERE {where})
  WHERE rn = 1)"""


BRONZE_ALL = _latest("bronze_all")
FIRST = _latest("first_raw", f"ts < {SPLIT}") + """,
first AS (SELECT nct_id, last_update_posted, raw, status FROM first_raw)"""
SECOND = _latest("second", f"ts >= {SPLIT}")
MERGED = """merged AS (
  SELECT coalesce(t.nct_id, s.nct_id) AS nct_id,
         CASE WHEN s.nct_id IS NOT NULL THEN s.last_update_posted ELSE t.last_update_posted END AS last_update_posted,
         CASE WHEN s.nct_id IS NOT NULL THEN s.raw ELSE t.raw END AS raw,
         CASE WHEN s.nct_id IS NOT NULL THEN s.status ELSE t.status END AS status,
         CASE WHEN s.nct_id IS NULL THEN 'keep' WHEN t.nct_id IS NULL THEN 'insert' ELSE 'update' END AS merge_action
  FROM first t FULL OUTER JOIN second s ON t.nct_id = s.nct_id)"""

RUNS = """days AS (
  SELECT CAST(ts AS DATE) AS day, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS studies_written,
         max(CAST(ts AS DATE)) AS max_date, arg_max(event_type, event_id) AS last_status
  FROM events GROUP BY 1),
runs AS (
  SELECT 'backfill-' || strftime(day, '%Y%m%d') AS run_id,
         CASE WHEN max(CASE WHEN last_status <> 'error' THEN 1 END) OVER (
                ORDER BY started_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1
              THEN 'incremental' ELSE 'full' END AS mode,
         started_at, finished_at, studies_written,
         CASE WHEN last_status <> 'error' THEN max(max_date) OVER (
                ORDER BY started_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS watermark,
         last_status <> 'error' AS complete
  FROM days)"""
SAFE_WM = "(SELECT max_by(watermark, finished_at) FROM runs WHERE complete AND watermark IS NOT NULL)"

ATTEMPTS = f"""attempt_log AS (
  SELECT d.nct_id, d.doc_id, d.eligibility, d.lang,
         CASE WHEN l.toxic = 1 THEN {_q(S.THROTTLE_MSG)} WHEN l.quality = 1 THEN NULL
              ELSE {_q(S.SCHEMA_MSG)} END AS error
  FROM bronze_docs d JOIN labels l ON d.doc_id = l.doc_id)"""
OUTCOMES = f"""outcomes AS (
  SELECT *, printf('%s-%04d', {_q('silver-' + S.RUN_TOKEN)}, batch_index) AS batch FROM (
    SELECT *, (row_number() OVER (ORDER BY nct_id) - 1) // {S.BATCH_SIZE} AS batch_index FROM attempt_log))"""
SILVER = f"""silver_current AS (
  SELECT r.nct_id, {SIG} AS signature, r.ordinal, r.criterion_id, r.text, r.kind, r.is_exclusion, o.batch
  FROM rule_criteria r JOIN outcomes o ON r.nct_id = o.nct_id WHERE o.error IS NULL),
line_criteria AS (
  SELECT nct_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS ordinal, unnest(ls) AS text
  FROM (SELECT nct_id, list_filter(string_split(eligibility, chr(10)), lambda l: coalesce(regexp_matches(l, '\\S'), false)) AS ls
        FROM bronze_docs)),
silver_table AS (
  SELECT nct_id, {LEGACY} AS signature, ordinal, 'c-' || CAST(ordinal AS VARCHAR) AS criterion_id, text,
         'other' AS kind, false AS is_exclusion, 'legacy-0000' AS batch
  FROM line_criteria
  UNION ALL SELECT * FROM silver_current)"""
FAILURES = f"""error_outcomes AS (
  SELECT {NCT.format('user_id')} AS nct_id, event_id AS seq, 'upstream error ' || props AS error
  FROM events WHERE event_type = 'error'),
failures_before AS (
  SELECT nct_id, {SIG} AS signature, substr(coalesce(arg_max(error, seq), 'unknown'), 1, {TX.ERROR_CUT}) AS error,
         CAST(count(*) AS INTEGER) AS attempts
  FROM error_outcomes WHERE error IS NOT NULL AND NOT ({THROTTLED.format('error')}) GROUP BY nct_id),
batch_failed AS (
  SELECT nct_id, count(*) AS n, min(error) AS err FROM attempt_log
  WHERE error IS NOT NULL AND NOT ({THROTTLED.format('error')}) GROUP BY nct_id),
failures_after AS (
  SELECT coalesce(t.nct_id, s.nct_id) AS nct_id, coalesce(t.signature, {SIG}) AS signature,
         CASE WHEN s.n IS NOT NULL THEN substr(coalesce(s.err, 'unknown'), 1, {TX.ERROR_CUT}) ELSE t.error END AS error,
         CAST(coalesce(t.attempts, 0) + coalesce(s.n, 0) AS INTEGER) AS attempts
  FROM failures_before t FULL OUTER JOIN batch_failed s ON t.nct_id = s.nct_id),
failures_cleared AS (
  SELECT * FROM failures_after f WHERE signature = {SIG}
    AND NOT EXISTS (SELECT 1 FROM attempt_log a WHERE a.error IS NULL AND a.nct_id = f.nct_id)
  UNION ALL SELECT * FROM failures_after WHERE signature <> {SIG})"""


def _pending_cte(retry_failed: bool) -> str:
    extra = "" if retry_failed else f"""
    AND NOT EXISTS (SELECT 1 FROM failures_cleared f WHERE f.nct_id = b.nct_id
                    AND f.signature = {SIG} AND f.attempts >= 3)"""
    return f"""pending AS (
  SELECT b.nct_id, b.eligibility FROM bronze_docs b
  WHERE length(b.eligibility) > 0
    AND NOT EXISTS (SELECT 1 FROM attempt_log a WHERE a.error IS NULL AND a.nct_id = b.nct_id){extra})"""


SILVER_STATS = f"""stats AS (
  SELECT (SELECT count(DISTINCT nct_id) FROM silver_table WHERE signature = {SIG}) AS trials,
         (SELECT count(*) FROM silver_table WHERE signature = {SIG}) AS criteria,
         (SELECT count(*) FROM failures_cleared WHERE signature = {SIG}) AS failed,
         (SELECT count(*) FROM bronze_docs WHERE eligibility IS NOT NULL) AS total)"""

SILVER_ALL = f"WITH {BRONZE_DOCS}, {RULE_CRITERIA}, {ATTEMPTS}, {OUTCOMES}, {SILVER}, {FAILURES}"

# Model replies: the same six envelope shapes, built and parsed in SQL.
_LINES = f"list_filter(string_split(text, chr(10)), lambda l: {HAS_TEXT.format('l')})"
_CRIT = ("CAST(to_json({'criteria': list_transform(" + _LINES + ", lambda l, i: {'criterion_id': 'c-' || "
         "CAST(i - 1 AS VARCHAR), 'text': l, 'kind': 'other', 'is_exclusion': false})}) AS VARCHAR)")


def _msg(content: str) -> str:
    return ("to_json({'choices': [{'message': {'role': 'assistant', 'content': " + content +
            "}, 'finish_reason': 'stop'}]})")


REPLIES = f"""replies AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % {S.REPLY_SHAPES}
    WHEN 0 THEN {_msg(_CRIT)}
    WHEN 1 THEN {_msg("[{'type': 'reasoning', 'text': 'thinking'}, {'type': 'text', 'text': " + _CRIT + "}]")}
    WHEN 2 THEN to_json({{'choices': [{{'message': {{'content': '{{'}}, 'finish_reason': 'length'}}]}})
    WHEN 3 THEN {_msg('text')}
    WHEN 4 THEN {_msg('42')}
    ELSE '{{"nope":true}}' END AS envelope
  FROM conversations WHERE role = 'assistant'),
reply_parts AS (
  SELECT conv_id, turn, envelope,
         json_extract(envelope, '$.choices[0].message') IS NOT NULL AS has_message,
         json_type(envelope, '$.choices[0].message.content') AS ctype,
         json_extract_string(envelope, '$.choices[0].finish_reason') AS finish
  FROM replies),
reply_texts AS (
  SELECT *, CASE WHEN NOT coalesce(has_message, false) THEN {_q(E.ERR_ENVELOPE)}
                 WHEN txt IS NULL THEN {_q(E.ERR_NO_TEXT)} END AS rt_error
  FROM (SELECT *, CASE
      WHEN ctype = 'VARCHAR' THEN json_extract_string(envelope, '$.choices[0].message.content')
      WHEN ctype = 'ARRAY' THEN (
        SELECT CASE WHEN len(tp) > 0 THEN array_to_string(tp, '') END FROM (
          SELECT list_transform(list_filter(
                   from_json(json_extract(envelope, '$.choices[0].message.content'),
                             '[{{"type":"VARCHAR","text":"VARCHAR"}}]'),
                   lambda p: p.type = 'text'), lambda p: coalesce(p.text, '')) AS tp))
      END AS txt FROM reply_parts)),
reply_valid AS (
  SELECT *, CASE WHEN rt_error IS NULL AND json_valid(txt) AND json_type(txt, '$.criteria') = 'ARRAY' THEN
      CASE WHEN json_array_length(txt, '$.criteria') = 0 THEN true ELSE coalesce(list_bool_and(list_transform(
        json_extract(txt, '$.criteria[*]'), lambda e: coalesce(
          json_type(e, '$.criterion_id') = 'VARCHAR' AND json_type(e, '$.text') = 'VARCHAR'
          AND json_type(e, '$.is_exclusion') = 'BOOLEAN'
          AND json_extract_string(e, '$.kind') IN ({", ".join(_q(k) for k in CRITERION_KINDS)}), false))), false) END
    ELSE false END AS valid
  FROM reply_texts),
parsed AS (
  SELECT conv_id, turn, outcome,
         CASE WHEN outcome = 'ok' THEN CAST(json_array_length(txt, '$.criteria') AS INTEGER) END AS n_criteria,
         CASE WHEN outcome = 'truncated' THEN {_q(E.ERR_TRUNCATED)} WHEN outcome = 'schema_error' THEN {_q(E.ERR_SCHEMA)}
              ELSE rt_error END AS error
  FROM (SELECT *, CASE WHEN rt_error = {_q(E.ERR_ENVELOPE)} THEN 'envelope_error'
                       WHEN finish = 'length' THEN 'truncated'
                       WHEN rt_error IS NOT NULL THEN 'text_error'
                       WHEN NOT valid THEN 'schema_error' ELSE 'ok' END AS outcome FROM reply_valid))"""


def _budget(text: str) -> str:
    return (f"CAST(greatest({TX.MIN_MAX_TOKENS}, least(floor(CAST(length({text}) AS DOUBLE) / "
            f"{TX.CHARS_PER_TOKEN}.0E0 * {TX.OUTPUT_RATIO}E0), {TX.MAX_TOKEN_CEILING})) AS BIGINT)")


REGISTRY = """registry AS (
  SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), greatest(8, length(CAST(o_orderkey AS VARCHAR)))::INTEGER, '0') AS nct_id, o_orderkey,
         o_orderstatus AS overall_status, o_orderpriority AS priority,
         CAST(o_orderdate AS DATE) AS start_date,
         CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(CAST(o_orderdate AS DATE), '%Y')
              WHEN o_orderpriority = '2-HIGH' THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m')
              ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS start_text,
         o_totalprice AS enrollment,
         'NCT' || lpad(CAST(o_custkey AS VARCHAR), greatest(8, length(CAST(o_custkey AS VARCHAR)))::INTEGER, '0') AS alias
  FROM orders)"""

FULL_RE, MONTH_RE, YEAR_RE = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'", "'^[0-9]{4}-[0-9]{2}$'", "'^[0-9]{4}$'"


def _lo(t: str) -> str:
    return (f"CASE WHEN regexp_matches({t}, {FULL_RE}) THEN TRY_CAST({t} AS DATE) "
            f"WHEN regexp_matches({t}, {MONTH_RE}) THEN TRY_CAST({t} || '-01' AS DATE) "
            f"WHEN regexp_matches({t}, {YEAR_RE}) THEN TRY_CAST({t} || '-01-01' AS DATE) END")


def _hi(t: str) -> str:
    return (f"CASE WHEN regexp_matches({t}, {FULL_RE}) THEN TRY_CAST({t} AS DATE) "
            f"WHEN regexp_matches({t}, {MONTH_RE}) THEN last_day(TRY_CAST({t} || '-01' AS DATE)) "
            f"WHEN regexp_matches({t}, {YEAR_RE}) THEN TRY_CAST({t} || '-12-31' AS DATE) END")


def _fmt(t: str) -> str:
    return (f"CASE WHEN regexp_matches({t}, {FULL_RE}) THEN 'yyyy-MM-dd' "
            f"WHEN regexp_matches({t}, {MONTH_RE}) THEN 'yyyy-MM' "
            f"WHEN regexp_matches({t}, {YEAR_RE}) THEN 'yyyy' END")


DUR_RE = _q(r"^\s*([0-9]+(?:\.[0-9]+)?)\s+([A-Za-z]+?)S?\s*$")


def _minutes(t: str) -> str:
    u = f"regexp_extract(upper({t}), {DUR_RE}, 2)"
    n = f"regexp_extract(upper({t}), {DUR_RE}, 1)"
    arms = " ".join(f"WHEN {u} = {_q(k)} THEN {v!r}E0" for k, v in MINUTES_PER_UNIT.items())
    return f"(CASE WHEN {n} <> '' THEN TRY_CAST({n} AS DOUBLE) * (CASE {arms} END) END)"


def _canon(t: str) -> str:
    r = _q("^NCT0*([0-9]+)$")
    digits = f"regexp_extract(upper(trim({t})), {r}, 1)"
    return (f"(CASE WHEN regexp_matches(upper(trim({t})), {r}) THEN 'NCT' || "
            f"lpad({digits}, CAST(greatest(8, length({digits})) AS INTEGER), '0') END)")


def _top(counts: str, value: str, count: str) -> str:
    order = f"{count} DESC, {value} ASC"
    return (f"(SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank "
            f"FROM (SELECT * FROM {counts} ORDER BY {order} LIMIT {TOP_N}))")


O: dict[str, str] = ORACLES

# ---- Bronze ----------------------------------------------------------------------------

O["bronze_dedupe_latest"] = f"""WITH {UPDATES}, {BRONZE_ALL}
SELECT nct_id, seq, last_update_posted, raw, status FROM bronze_all"""

# ---- Registry pages: what a reader of the pages' JSON must find, without the JSON ----

PAGES = f"""faulty AS (
  SELECT doc_id // {S.PAGE_STUDIES} AS page_no, doc_id, text AS eligibility,
         {NCT.format('doc_id')} AS nct_id, doc_id % 3 = 0 AS done,
         CASE WHEN doc_id % 5 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) AS DATE) END AS posted,
         CASE WHEN lang = 'en' AND source = 'src4' THEN 1 WHEN lang = 'es' AND source = 'src1' THEN 2
              WHEN lang = 'fr' AND source = 'src2' THEN 3 WHEN lang = 'de' AND source = 'src3' THEN 4 END AS fault
  FROM documents),
problems AS (
  SELECT page_no, CASE min(fault) WHEN 1 THEN 'malformed page or wrong type' WHEN 2 THEN 'unknown enum value'
                    WHEN 3 THEN 'not a full date' WHEN 4 THEN 'trial id without 11 characters' END AS problem
  FROM faulty GROUP BY page_no),
good AS (SELECT faulty.* FROM faulty JOIN problems USING (page_no) WHERE problem IS NULL)"""
O["page_problems"] = f"WITH {PAGES} SELECT page_no, problem FROM problems"
O["page_studies"] = f"""WITH {PAGES}
SELECT page_no, CAST(row_number() OVER (PARTITION BY page_no ORDER BY doc_id) - 1 AS BIGINT) AS pos, nct_id FROM good"""
O["study_columns"] = f"""WITH {PAGES}
SELECT page_no, nct_id, posted AS last_update_posted, CASE WHEN done THEN 'COMPLETED' ELSE 'RECRUITING' END AS overall_status,
       eligibility, CASE WHEN eligibility IS NOT NULL THEN true END AS raw_agrees FROM good"""
O["bronze_merge"] = f"""WITH {UPDATES}, {FIRST}, {SECOND}, {MERGED} SELECT * FROM merged"""

O["bronze_merge_counts"] = f"""WITH {UPDATES}, {FIRST}, {SECOND}, {MERGED}
SELECT count(*) FILTER (WHERE merge_action <> 'insert') AS rows_before,
       count(*) FILTER (WHERE merge_action <> 'keep') AS written,
       count(*) AS rows_after,
       count(*) FILTER (WHERE merge_action = 'insert') AS added,
       count(*) FILTER (WHERE merge_action = 'update') AS updated
FROM merged"""

_DIFF = " OR ".join(f"b.{c} IS DISTINCT FROM a.{c}" for c in ("last_update_posted", "raw", "status"))
O["bronze_change_feed"] = f"""WITH {UPDATES}, {FIRST}, {SECOND}, {MERGED}
SELECT a.nct_id, a.last_update_posted, a.raw, a.status, 'insert' AS change_type FROM merged a
  WHERE NOT EXISTS (SELECT 1 FROM first b WHERE b.nct_id = a.nct_id)
UNION ALL SELECT b.nct_id, b.last_update_posted, b.raw, b.status, 'delete' FROM first b
  WHERE NOT EXISTS (SELECT 1 FROM merged a WHERE b.nct_id = a.nct_id)
UNION ALL SELECT b.nct_id, b.last_update_posted, b.raw, b.status, 'update_preimage'
  FROM first b JOIN merged a ON a.nct_id = b.nct_id WHERE {_DIFF}
UNION ALL SELECT a.nct_id, a.last_update_posted, a.raw, a.status, 'update_postimage'
  FROM first b JOIN merged a ON a.nct_id = b.nct_id WHERE {_DIFF}"""

# The versions before the last two merges and after them are the two sides of the change feed.
O["bronze_version_changes"] = O["bronze_change_feed"]
O["bronze_keyed_merge"] = f"""WITH {UPDATES}, {FIRST}, {SECOND}, {MERGED}
SELECT nct_id, last_update_posted, raw, status FROM merged"""
O["bronze_tallies"] = f"""WITH {UPDATES}, {FIRST}, {SECOND}, {MERGED}, long AS (
  SELECT '*' AS field, NULL AS value FROM merged
  UNION ALL SELECT 'status', status FROM merged
  UNION ALL SELECT 'last_update_posted', CAST(last_update_posted AS VARCHAR) FROM merged
  UNION ALL SELECT 'bytes', CAST(strlen(raw) AS VARCHAR) FROM merged)
SELECT field, value, count(*) AS n FROM long GROUP BY field, value"""
O["bronze_footer_stats"] = f"""WITH {UPDATES}, {BRONZE_ALL}
SELECT count(*) AS rows, max(last_update_posted) AS newest FROM bronze_all"""
O["bronze_point_read"] = f"""WITH {BRONZE_DOCS}
SELECT nct_id, eligibility, lang, source FROM bronze_docs WHERE nct_id = {_q(C.POINT_ID)}"""
O["study_problems"] = f"""WITH {PAGES}
SELECT page_no, CAST(row_number() OVER (PARTITION BY page_no ORDER BY doc_id) - 1 AS BIGINT) AS pos,
       CASE WHEN fault IS NULL THEN nct_id END AS nct_id,
       CASE fault WHEN 1 THEN 'malformed page or wrong type' WHEN 2 THEN 'unknown enum value'
                  WHEN 3 THEN 'not a full date' WHEN 4 THEN 'trial id without 11 characters' END AS problem
FROM faulty"""
O["bronze_count"] = f"WITH {UPDATES}, {BRONZE_ALL} SELECT count(*) AS bronze_rows FROM bronze_all"
O["bronze_max_update"] = f"WITH {UPDATES}, {BRONZE_ALL} SELECT max(last_update_posted) AS max_update FROM bronze_all"
O["bronze_skipped_rows"] = """SELECT count(*) FILTER (WHERE event_type <> 'error') AS kept_rows,
       count(*) FILTER (WHERE event_type = 'error') AS skipped_rows FROM events"""
O["limited_scan"] = f"WITH {UPDATES} SELECT nct_id, seq, status FROM updates ORDER BY seq LIMIT {C.SCAN_LIMIT}"
O["study_by_id"] = f"""WITH {BRONZE_DOCS}
SELECT nct_id, eligibility, lang, source FROM bronze_docs WHERE nct_id = {_q(C.POINT_ID)}"""
O["json_path_value"] = f"""WITH {BRONZE_DOCS}
SELECT nct_id, json_extract_string(json_object('protocolSection', json_object(
         'identificationModule', json_object('nctId', nct_id),
         'eligibilityModule', json_object('eligibilityCriteria', eligibility))),
       {_q(ELIGIBILITY_JSON_PATH)}) AS eligibility
FROM bronze_docs"""
_SCOPE = f"""WITH {BRONZE_DOCS}, scoped AS (
  SELECT nct_id, lang, source FROM bronze_docs
  WHERE coalesce(list_contains(string_split(eligibility, ' '), {_q(C.SCOPE_TERM)}), false)
    AND lang = {_q(C.SCOPE_TYPE)} AND source IN ({", ".join(_q(x) for x in C.SCOPE_STATUSES)}))"""
O["scope_filter"] = f"{_SCOPE} SELECT * FROM scoped"
O["scope_count"] = f"{_SCOPE} SELECT count(*) AS scope_count FROM scoped"
O["updated_since"] = f"""WITH {UPDATES}
SELECT nct_id, seq, last_update_posted FROM updates
WHERE last_update_posted >= DATE {_q(C.SINCE)}"""
O["custom_predicate"] = f"""WITH {BRONZE_DOCS}
SELECT nct_id, n_chars FROM bronze_docs WHERE n_chars BETWEEN 500 AND 2000 AND lang = 'de'"""
O["valid_ids"] = """SELECT doc_id, candidate, coalesce(regexp_matches(candidate, '^NCT[0-9]{8}$'), false) AS valid
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'NCT' || lpad(CAST(doc_id AS VARCHAR), greatest(8, length(CAST(doc_id AS VARCHAR)))::INTEGER, '0')
                          WHEN lang = 'fr' THEN 'NCT' || CAST(doc_id AS VARCHAR)
                          WHEN lang = 'de' THEN 'nct' || lpad(CAST(doc_id AS VARCHAR), greatest(8, length(CAST(doc_id AS VARCHAR)))::INTEGER, '0')
                          ELSE 'NCT' || lpad(CAST(doc_id AS VARCHAR), greatest(9, length(CAST(doc_id AS VARCHAR)))::INTEGER, '0') END AS candidate
      FROM documents)"""
O["strict_date"] = f"""SELECT event_id, date_text,
       CASE WHEN regexp_matches(date_text, {FULL_RE}) THEN TRY_CAST(date_text AS DATE) END AS parsed
FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d')
                            WHEN event_type = 'click' THEN strftime(ts, '%Y-%m')
                            WHEN event_type = 'signup' THEN 'not-a-date'
                            WHEN event_type = 'purchase' THEN '2024-02-' || lpad(CAST(day(ts) AS VARCHAR), 2, '0')
                            ELSE '' END AS date_text FROM events)"""

# ---- ledger ------------------------------------------------------------------------------

O["safe_watermark"] = f"WITH {RUNS} SELECT {SAFE_WM} AS watermark"
O["run_watermark"] = f"WITH {RUNS} SELECT run_id, mode, studies_written, watermark, complete FROM runs"

# ---- Silver -------------------------------------------------------------------------------

O["silver_criteria_rows"] = f"""{SILVER_ALL}
SELECT nct_id, signature, ordinal, criterion_id, text, kind, is_exclusion FROM silver_current"""
O["signature_scope"] = f"""{SILVER_ALL}
SELECT nct_id, count(*) AS criteria FROM silver_table WHERE signature = {SIG} GROUP BY nct_id"""
O["distinct_trials"] = f"{SILVER_ALL} SELECT DISTINCT nct_id FROM silver_current"
O["batch_assignment"] = f"""WITH {BRONZE_DOCS}, {ATTEMPTS}, {OUTCOMES}
SELECT nct_id, batch_index, batch FROM outcomes"""
O["batch_counts"] = f"""{SILVER_ALL}
SELECT batch, count(*) AS criteria, count(DISTINCT nct_id) AS trials FROM silver_current GROUP BY batch"""
O["staging_strings"] = f"""WITH {BRONZE_DOCS}, {RULE_CRITERIA}
SELECT nct_id, CAST(ordinal AS VARCHAR) AS ordinal_text, CAST(is_exclusion AS VARCHAR) AS is_exclusion_text,
       ordinal AS ordinal_int, is_exclusion AS is_exclusion_bool FROM rule_criteria"""
O["pending_trials"] = f"{SILVER_ALL}, {_pending_cte(False)} SELECT nct_id FROM pending"
O["pending_retry_failed"] = f"{SILVER_ALL}, {_pending_cte(True)} SELECT nct_id FROM pending"
O["pending_limited"] = f"""{SILVER_ALL}, {_pending_cte(False)}
SELECT nct_id FROM pending ORDER BY nct_id LIMIT {C.PENDING_LIMIT}"""
O["silver_replace"] = f"""{SILVER_ALL},
src AS (SELECT nct_id, {SIG} AS signature, ordinal, criterion_id, text, kind, is_exclusion,
               {_q(C.REPLACE_BATCH)} AS batch
        FROM rule_criteria WHERE nct_id IN (SELECT nct_id FROM bronze_docs WHERE lang = {_q(C.REPLACE_LANG)}))
SELECT nct_id, signature, ordinal, kind, is_exclusion, batch FROM silver_table t
  WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.nct_id = t.nct_id AND s.signature = t.signature)
UNION ALL SELECT nct_id, signature, ordinal, kind, is_exclusion, batch FROM src"""
O["failures_accumulate"] = f"{SILVER_ALL} SELECT * FROM failures_after"
O["failures_cleared"] = f"{SILVER_ALL} SELECT * FROM failures_cleared"
O["run_counters"] = f"""WITH {BRONZE_DOCS}, {ATTEMPTS}
SELECT count(*) FILTER (WHERE error IS NULL) AS succeeded,
       count(*) FILTER (WHERE error IS NOT NULL) AS failed,
       count(*) FILTER (WHERE error IS NOT NULL AND {THROTTLED.format('error')}) AS rate_limited,
       count(*) AS attempted FROM attempt_log"""
O["silver_stats"] = f"{SILVER_ALL}, {SILVER_STATS} SELECT trials, criteria, failed, total FROM stats"
O["run_result"] = f"""{SILVER_ALL}, {SILVER_STATS},
rc AS (SELECT count(*) FILTER (WHERE error IS NULL) AS succeeded,
              count(*) FILTER (WHERE error IS NOT NULL) AS failed,
              count(*) FILTER (WHERE error IS NOT NULL AND {THROTTLED.format('error')}) AS rate_limited
       FROM outcomes)
SELECT {SIG} AS signature,
       (SELECT count(*) FROM outcomes WHERE error IS NULL) AS trials_written,
       (SELECT count(*) FROM silver_current) AS criteria_written,
       succeeded, failed, rate_limited,
       (SELECT total - trials FROM stats) AS remaining,
       ((SELECT total - trials FROM stats) > 0 AND rate_limited > 0 AND failed > 0) AS quota_exhausted
FROM rc"""
O["status"] = f"""{SILVER_ALL}, {SILVER_STATS}, {UPDATES}, {BRONZE_ALL}, {RUNS}
SELECT (SELECT count(*) FROM bronze_docs) AS bronze_rows,
       (SELECT max(last_update_posted) FROM bronze_all) AS newest_update,
       {SAFE_WM} AS resume_point,
       trials, total, criteria, failed,
       round(CAST(trials AS DOUBLE) * 100.0E0 / CAST(greatest(total, 1) AS DOUBLE), 1) AS percent
FROM stats"""
O["throttle_stop"] = f"""WITH {BRONZE_DOCS}, {ATTEMPTS},
tb AS (SELECT nct_id, error, (row_number() OVER (ORDER BY nct_id) - 1) // {C.STOP_BATCH_SIZE} AS batch_index
       FROM attempt_log),
per AS (SELECT batch_index, count(*) AS attempted,
               count(*) FILTER (WHERE error IS NULL) AS succeeded,
               count(*) FILTER (WHERE error IS NOT NULL) AS failed,
               count(*) FILTER (WHERE error IS NOT NULL AND {THROTTLED.format('error')}) AS rate_limited
        FROM tb GROUP BY batch_index),
st AS (SELECT *, coalesce(succeeded = 0 AND batch_index >= (SELECT min(batch_index) FROM per WHERE rate_limited > 0),
                          false) AS stops FROM per)
SELECT *, coalesce(batch_index <= (SELECT min(batch_index) FROM st WHERE stops), true) AS ran FROM st"""

# ---- requests and replies ------------------------------------------------------------------

O["extraction_requests"] = f"""{SILVER_ALL}, {_pending_cte(False)}
SELECT nct_id, {_budget('eligibility')} AS max_tokens,
       '{{"messages":' || to_json([{{'role': 'system', 'content': {_q(E.SYSTEM_PROMPT)}}},
                                  {{'role': 'user', 'content': eligibility}}])
       || ',"temperature":0,"max_tokens":' || CAST({_budget('eligibility')} AS VARCHAR)
       || ',"response_format":' || {_q(E.RESPONSE_FORMAT_JSON)} || '}}' AS request
FROM pending"""
O["reply_text"] = f"""WITH {REPLIES}
SELECT conv_id, turn, CASE WHEN rt_error IS NULL THEN txt END AS reply_text, rt_error AS error FROM reply_texts"""
O["outcome_classes"] = f"""WITH {REPLIES}
SELECT conv_id, turn, outcome, n_criteria, {THROTTLED.format('error')} AS throttled FROM parsed"""
O["truncation_retries"] = f"""WITH {REPLIES},
req AS (SELECT conv_id, turn + 1 AS turn, text AS request_text FROM conversations WHERE role = 'user'),
t AS (SELECT p.conv_id, p.turn, {_budget('r.request_text')} AS max_tokens
      FROM parsed p JOIN req r ON p.conv_id = r.conv_id AND p.turn = r.turn WHERE p.outcome = 'truncated')
SELECT conv_id, turn, max_tokens, least(max_tokens * 2, {TX.MAX_TOKEN_CEILING}) AS retry_tokens FROM t
WHERE least(max_tokens * 2, {TX.MAX_TOKEN_CEILING}) > max_tokens"""
O["blank_results"] = f"""WITH {BRONZE_DOCS}
SELECT nct_id, NOT {HAS_TEXT.format('eligibility')} AS is_blank,
       CAST(len(list_filter(string_split(eligibility, chr(10)), lambda l: {HAS_TEXT.format('l')})) AS INTEGER) AS nonblank_lines,
       CAST(len(list_filter(string_split(eligibility, chr(10)), lambda l: NOT {HAS_TEXT.format('l')})) AS INTEGER) AS blank_lines
FROM bronze_docs"""
O["token_budget"] = f"""WITH {BRONZE_DOCS}, t AS (SELECT nct_id, {_budget('eligibility')} AS max_tokens FROM bronze_docs)
SELECT nct_id, max_tokens,
       CASE WHEN least(max_tokens * 2, {TX.MAX_TOKEN_CEILING}) > max_tokens
            THEN least(max_tokens * 2, {TX.MAX_TOKEN_CEILING}) END AS retry_tokens FROM t"""
O["content_signature"] = f"""WITH {BRONZE_DOCS}
SELECT nct_id, substr(sha256(to_json({{'eligibility': eligibility, 'lang': lang, 'source': source}})), 1, 16) AS signature
FROM bronze_docs"""

# ---- statistics -----------------------------------------------------------------------------

O["stats_enum"] = f"""WITH pairs AS (SELECT DISTINCT c_custkey, c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL),
counts AS (SELECT value, count(*) AS studies FROM pairs GROUP BY value)
SELECT value, studies, rank, (SELECT count(*) FROM counts) AS unique_values,
       (SELECT count(*) FILTER (WHERE c_mktsegment IS NULL) FROM customer) AS missing
FROM {_top('counts', 'value', 'studies')}"""
O["stats_string"] = f"""WITH pairs AS (SELECT DISTINCT p_partkey, p_type AS value FROM part WHERE p_type IS NOT NULL),
counts AS (SELECT value, count(*) AS studies FROM pairs GROUP BY value),
lg AS (SELECT p_type AS v, p_partkey AS i, CAST(length(p_type) AS INTEGER) AS l FROM part WHERE p_type IS NOT NULL
       ORDER BY length(p_type) DESC, p_partkey ASC LIMIT 1)
SELECT value, studies, rank, (SELECT count(*) FROM counts) AS unique_values,
       (SELECT count(*) FILTER (WHERE p_type IS NULL) FROM part) AS missing,
       (SELECT v FROM lg) AS longest_value, (SELECT i FROM lg) AS longest_id, (SELECT l FROM lg) AS longest_chars
FROM {_top('counts', 'value', 'studies')}"""
O["stats_date"] = f"""WITH {REGISTRY}
SELECT min({_lo('start_text')}) AS min_date, max({_hi('start_text')}) AS max_date,
       string_agg(DISTINCT {_fmt('start_text')}, ',' ORDER BY {_fmt('start_text')}) AS formats,
       count(*) FILTER (WHERE start_text IS NULL) AS missing
FROM registry"""


def _num(table: str, col: str) -> str:
    return (f"SELECT {_q(col)} AS field, min(CAST({col} AS DOUBLE)) AS min_value, "
            f"max(CAST({col} AS DOUBLE)) AS max_value, round(avg(CAST({col} AS DOUBLE)), 4) AS avg_value, "
            f"count(*) FILTER (WHERE {col} IS NULL) AS missing FROM {table}")


O["stats_numeric"] = f"{_num('orders', 'o_totalprice')} UNION ALL {_num('part', 'p_size')}"
O["stats_boolean"] = """WITH j AS (SELECT l.quality = 1 AS quality, l.toxic = 1 AS toxic
                        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'quality' AS field, count(*) FILTER (WHERE quality) AS true_count,
       count(*) FILTER (WHERE NOT quality) AS false_count, count(*) FILTER (WHERE quality IS NULL) AS missing FROM j
UNION ALL
SELECT 'toxic', count(*) FILTER (WHERE toxic), count(*) FILTER (WHERE NOT toxic),
       count(*) FILTER (WHERE toxic IS NULL) FROM j"""
O["list_sizes"] = f"""WITH sizes AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey),
counts AS (SELECT size, count(*) AS studies FROM sizes GROUP BY size)
SELECT size, studies, rank, (SELECT min(size) FROM sizes) AS min_size, (SELECT max(size) FROM sizes) AS max_size,
       (SELECT count(*) FROM counts) AS unique_sizes
FROM {_top('counts', 'size', 'studies')}"""

_RANGE_LABEL = "CASE " + " ".join(
    f"WHEN bytes >= {lo}" + (f" AND bytes < {hi}" if hi is not None else "") +
    f" THEN '{lo}-{hi if hi is not None else 'max'}'" for lo, hi in SIZE_RANGES) + " END"
_RANGE_LO = "CASE " + " ".join(
    f"WHEN bytes >= {lo}" + (f" AND bytes < {hi}" if hi is not None else "") +
    f" THEN CAST({lo} AS BIGINT)" for lo, hi in SIZE_RANGES) + " END"
O["size_stats"] = f"""WITH {BRONZE_DOCS}, b AS (SELECT nct_id, CAST(strlen(eligibility) AS BIGINT) AS bytes FROM bronze_docs)
SELECT {_RANGE_LABEL} AS size_range, {_RANGE_LO} AS range_lo, count(*) AS docs,
       (SELECT count(*) FROM b) AS total_docs, (SELECT CAST(sum(bytes) AS BIGINT) FROM b) AS total_bytes,
       (SELECT CAST(sum(bytes) AS DOUBLE) / CAST(count(*) AS DOUBLE) FROM b) AS avg_bytes,
       (SELECT nct_id FROM b ORDER BY bytes DESC, nct_id ASC LIMIT 1) AS largest_id,
       (SELECT max(bytes) FROM b) AS largest_bytes,
       {", ".join(f"(SELECT quantile_cont(bytes, {p}) FROM b) AS p{int(round(p * 100))}" for p in PERCENTILES)}
FROM b GROUP BY 1, 2"""

# ---- filters, sort, projection ------------------------------------------------------------

O["filter_status"] = f"""WITH {REGISTRY}
SELECT nct_id, overall_status FROM registry WHERE overall_status IN ({", ".join(_q(x) for x in C.STATUS_FILTER)})"""
_WANT = ", ".join(_q(x) for x in sorted({y for y in (_py_canonical(i) for i in C.ID_REQUEST) if y}))
O["filter_ids"] = f"""WITH {REGISTRY}
SELECT nct_id FROM registry WHERE {_canon('nct_id')} IN ({_WANT}) OR coalesce({_canon('alias')} IN ({_WANT}), false)"""
_LAT, _LON = C.GEO_CENTER
_LIMIT_KM = C.GEO_DISTANCE * KM_PER_UNIT[C.GEO_UNIT]


def _hav(lat: str, lon: str) -> str:
    return (f"{2 * EARTH_RADIUS_KM!r}E0 * asin(sqrt(pow(sin(radians({_LAT!r}E0 - {lat}) / 2), 2) + "
            f"cos(radians({lat})) * cos(radians({_LAT!r}E0)) * pow(sin(radians({_LON!r}E0 - {lon}) / 2), 2)))")


O["filter_geo"] = f"""SELECT vec_id FROM embeddings
WHERE len(list_filter(range(0, len(embedding) // 2), lambda i: {_hav(
    'CAST(embedding[2 * i + 1] AS DOUBLE) * 90.0E0', 'CAST(embedding[2 * i + 2] AS DOUBLE) * 180.0E0')} <= {_LIMIT_KM!r}E0)) > 0"""
O["geo_index"] = O["filter_geo"]
_PART_AGES = """ages AS (
  SELECT p_partkey,
         CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) || ' Months' ELSE CAST(p_size AS VARCHAR) || ' Years' END AS minimum_age,
         CASE WHEN p_brand LIKE '%1' THEN NULL ELSE CAST(p_size + 30 AS VARCHAR) || ' Years' END AS maximum_age
  FROM part)"""
O["filter_age"] = f"""WITH {_PART_AGES}
SELECT p_partkey, minimum_age, maximum_age FROM ages
WHERE ({_minutes('minimum_age')} IS NULL OR {_minutes('minimum_age')} <= {_minutes(_q(C.AGE_HI))})
  AND ({_minutes('maximum_age')} IS NULL OR {_minutes('maximum_age')} >= {_minutes(_q(C.AGE_LO))})"""
O["filter_partial_date"] = f"""WITH {REGISTRY}, r AS (SELECT nct_id, start_text, {_lo('start_text')} AS start_lo,
                                               {_hi('start_text')} AS start_hi FROM registry)
SELECT * FROM r WHERE start_lo IS NOT NULL AND start_lo <= DATE {_q(C.DATE_TO)} AND start_hi >= DATE {_q(C.DATE_FROM)}"""
O["sort_studies"] = f"""WITH {REGISTRY}
SELECT nct_id, start_date, enrollment,
       CAST(row_number() OVER (ORDER BY start_date DESC NULLS LAST, enrollment ASC NULLS LAST, nct_id ASC) AS INTEGER) AS position
FROM registry QUALIFY position <= 100"""
O["sort_pages"] = f"""WITH {REGISTRY}, r AS (
  SELECT nct_id, overall_status, CASE WHEN priority <> '5-LOW' THEN enrollment END AS enrollment FROM registry)
SELECT CAST((row_number() OVER (ORDER BY overall_status DESC NULLS LAST, enrollment ASC NULLS LAST, nct_id) - 1) // 100 + 1
            AS INTEGER) AS page, nct_id, overall_status, enrollment
FROM r QUALIFY page <= 3"""
O["date_range_matches"] = f"""WITH {REGISTRY}, r AS (
  SELECT nct_id, {_lo('start_text')} AS lo, {_hi('start_text')} AS hi FROM registry),
q AS (SELECT s_suppkey AS request, DATE '1992-01-01' + CAST(s_suppkey * 37 % 2400 AS INTEGER) AS s,
             CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey % 45 AS INTEGER) END AS n FROM supplier)
SELECT request, count(*) AS studies FROM q JOIN r ON r.hi >= q.s AND (n IS NULL OR r.lo <= q.s + n)
GROUP BY request"""
O["age_range_matches"] = f"""WITH {_PART_AGES},
q AS (SELECT s_suppkey AS request,
             CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 60 AS VARCHAR) || ' Years' END AS lo_text,
             CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 60 + s_suppkey % 9 AS VARCHAR) || ' Years' END AS hi_text
      FROM supplier),
a AS (SELECT round({_minutes('minimum_age')}) AS lo, round({_minutes('maximum_age')}) AS hi FROM ages),
b AS (SELECT request, round({_minutes('lo_text')}) AS s, round({_minutes('hi_text')}) AS e FROM q)
SELECT request, count(*) AS studies FROM b JOIN a
  ON (a.lo IS NULL OR b.e IS NULL OR a.lo <= b.e) AND (a.hi IS NULL OR b.s IS NULL OR a.hi >= b.s)
  AND (a.lo IS NULL OR a.hi IS NULL OR a.lo <= a.hi) AND (b.s IS NULL OR b.e IS NULL OR b.s <= b.e)
GROUP BY request"""
O["project_fields"] = f"""WITH {REGISTRY}
SELECT nct_id AS protocolSection_identificationModule_nctId, alias AS protocolSection_identificationModule_orgStudyId,
       overall_status AS protocolSection_statusModule_overallStatus FROM registry"""
