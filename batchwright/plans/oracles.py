"""Independent SQL (DuckDB dialect) for every registered query.

Each string runs against views named after the test tables.  The stand-in
derivations of ``plans/standins.py`` are repeated here as CTE snippets so the
oracle shares no code with the Spark side.  DuckDB's ``concat`` skips NULLs,
so ``||`` is used wherever Spark's NULL-propagating ``concat`` is meant.
"""

from __future__ import annotations

COMPANY_BASE = """
company_base AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS company_id,
    CASE WHEN o_orderstatus = 'F' THEN '01' ELSE o_orderstatus END AS company_type_code,
    'company-' || CAST(o_orderkey AS VARCHAR) AS company_name,
    o_custkey AS oper_key_no,
    'oper-' || CAST(o_custkey AS VARCHAR) AS oper_name,
    CAST(o_totalprice AS DECIMAL(18,2)) AS regist_capi,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE 'CNY' END AS regist_capi_curr_name,
    o_custkey AS rec_capi,
    o_orderstatus AS company_status_name,
    o_orderdate AS start_date,
    CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS end_date,
    'CC' || CAST(o_orderkey AS VARCHAR) AS credit_code,
    o_orderkey AS no,
    o_orderpriority AS econ_kind,
    substr(o_orderpriority, 1, 1) AS econ_kind_code,
    o_orderdate AS check_date,
    o_custkey % 7 AS belong_org,
    o_custkey % 31 AS province_code,
    'province-' || CAST(o_custkey % 31 AS VARCHAR) AS province_name,
    o_orderdate AS term_start,
    CAST(NULL AS TIMESTAMP) AS term_end,
    'addr ' || CAST(o_custkey AS VARCHAR) AS address,
    o_orderpriority AS scope,
    '555-' || CAST(o_orderkey AS VARCHAR) AS phone_number,
    CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INTEGER) AS TIMESTAMP) AS insert_time,
    o_orderdate AS update_time,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS is_del
  FROM orders)"""

COMPANY_MAPPING = """
company_mapping AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS v2_company_id,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS dwi_company_id,
    l_shipdate AS update_time,
    l_linenumber AS insert_time
  FROM lineitem)"""

PROJECT_VARIABLES = """
project_variables AS (
  SELECT CAST(o_custkey AS VARCHAR) AS project_id,
    'prj.p' || substr(o_orderpriority, 1, 1) AS name,
    CAST(o_orderkey AS VARCHAR) AS value,
    CAST(o_orderkey AS INTEGER) AS version,
    o_orderdate AS effective_at,
    o_orderkey AS seq
  FROM orders)"""

VARIABLE_LOOKUPS = """
variable_lookups AS (
  SELECT event_id AS lookup_id,
    CAST(user_id AS VARCHAR) AS project_id,
    'prj.p' || CAST(event_id % 5 + 1 AS VARCHAR) AS name,
    CAST(ts - INTERVAL 26 YEAR AS TIMESTAMP) AS "at"
  FROM events)"""

INSTANCE_EVENTS = """
instance_events AS (
  SELECT event_id,
    CAST(user_id AS VARCHAR) AS instance_id,
    'trace-' || CAST(user_id AS VARCHAR) AS trace_id,
    CAST(user_id % 10 AS VARCHAR) AS tenant_id,
    ts,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'submitting'
      WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded'
      WHEN 'error' THEN 'failed' END AS state,
    event_type,
    CAST(round(value * 60) AS BIGINT) AS duration_s
  FROM events)"""

RUNS = INSTANCE_EVENTS + """,
runs AS (
  SELECT event_id, instance_id, tenant_id, trace_id, state, duration_s,
    ts AS started_at,
    CASE WHEN state = 'failed' AND duration_s > 2400 THEN NULL
         ELSE ts + to_seconds(duration_s) END AS ended_at
  FROM instance_events)"""

TASK_VERSIONS = """
task_versions AS (
  SELECT CAST(o_custkey AS VARCHAR) AS task_id,
    o_orderkey AS version_id,
    o_orderdate AS baked_at,
    CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'superseded'
      ELSE 'baked' END AS status
  FROM orders)"""

# The published pointer's moves: a publish at its own time, whatever became of
# the version since, and a rollback (after a publish of the same instant).
HISTORY = TASK_VERSIONS + """,
history AS (
  SELECT task_id, baked_at AS moved_at, 0 AS rank, version_id AS id, version_id, 'publish' AS kind
  FROM task_versions WHERE status <> 'baked'
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), o_orderdate + INTERVAL 300 DAY, 1, o_orderkey, o_orderkey, 'rollback'
  FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'P')"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


COMPANY_DIM = with_(COMPANY_BASE, COMPANY_MAPPING, """
dedup_mid AS (
  SELECT * FROM (
    SELECT m.*, row_number() OVER (PARTITION BY v2_company_id
      ORDER BY update_time DESC NULLS LAST, insert_time DESC NULLS LAST,
               dwi_company_id DESC NULLS LAST) AS rn
    FROM company_mapping m
    WHERE dwi_company_id IS NOT NULL AND dwi_company_id <> ''
      AND v2_company_id IS NOT NULL AND v2_company_id <> '') t
  WHERE rn = 1),
transformed AS (
  SELECT CAST(NULL AS VARCHAR) AS key_no,
    CAST(mid.dwi_company_id AS VARCHAR) AS company_id,
    CAST(base.company_name AS VARCHAR) AS company_name,
    CAST(base.oper_key_no AS VARCHAR) AS oper_key_no,
    CAST(base.oper_name AS VARCHAR) AS oper_name,
    CAST(base.regist_capi AS VARCHAR) || CAST(base.regist_capi_curr_name AS VARCHAR) AS regist_capi,
    CAST(base.regist_capi AS VARCHAR) AS regist_capi_value,
    CAST(base.regist_capi_curr_name AS VARCHAR) AS regist_capi_unit,
    CAST(base.rec_capi AS VARCHAR) AS rec_cap,
    CAST(base.company_status_name AS VARCHAR) AS status,
    CAST(base.start_date AS VARCHAR) AS start_date,
    CAST(base.end_date AS VARCHAR) AS end_date,
    CAST(base.credit_code AS VARCHAR) AS credit_code,
    CAST(base.no AS VARCHAR) AS no,
    CAST(base.econ_kind AS VARCHAR) AS econ_kind,
    CAST(base.econ_kind_code AS VARCHAR) AS econ_kind_code,
    CAST(base.check_date AS VARCHAR) AS check_date,
    CAST(base.belong_org AS VARCHAR) AS belong_org,
    CAST(base.province_code AS VARCHAR) AS province_code,
    CAST(base.province_name AS VARCHAR) AS province,
    CAST(base.term_start AS VARCHAR) AS term_start,
    CAST(base.term_end AS VARCHAR) AS term_end,
    CAST(base.address AS VARCHAR) AS address,
    CAST(base.scope AS VARCHAR) AS scope,
    CAST(base.phone_number AS VARCHAR) AS phone_number,
    CAST(base.update_time AS VARCHAR) AS updated_date,
    '2026-06-13 00:00:00' AS dates,
    CASE WHEN base.is_del = '1' THEN '-1'
         WHEN CAST(base.insert_time AS DATE) = CAST(base.update_time AS DATE) THEN '1'
         ELSE '0' END AS isadd,
    row_number() OVER (PARTITION BY mid.dwi_company_id
      ORDER BY base.update_time DESC NULLS LAST, base.insert_time DESC NULLS LAST,
               base.company_id DESC NULLS LAST) AS target_rn
  FROM company_base base JOIN dedup_mid mid ON base.company_id = mid.v2_company_id
  WHERE base.company_type_code = '01')
SELECT key_no, company_id, company_name, oper_key_no, oper_name, regist_capi,
  regist_capi_value, regist_capi_unit, rec_cap, status, start_date, end_date,
  credit_code, no, econ_kind, econ_kind_code, check_date, belong_org, province_code,
  province, term_start, term_end, address, scope, phone_number, updated_date, dates, isadd
FROM transformed WHERE target_rn = 1
""")

ORACLES: dict[str, str] = {
    "company_dim": COMPANY_DIM,
}

SCRIPTS = r"""
scripts AS (
  SELECT event_id // 2 AS script_id, CAST(user_id AS VARCHAR) AS project_id,
    CAST(ts - INTERVAL 26 YEAR AS TIMESTAMP) AS "at",
    strftime(ts, '%Y%m%d') AS biz_date,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE strftime(ts, '%H') END AS biz_hour,
    event_id, event_type, ts, CAST(ts AS DATE) AS dd,
    CAST(event_id % 40 AS INTEGER) AS k40, CAST(event_id % 7 AS INTEGER) AS k7,
    CAST(event_id % 5 + 1 AS VARCHAR) AS k5,
    'SELECT count(*) AS n, ''${month}'' AS in_month, ''${date}'' AS on_day, ''${prj.p'
      || CAST(event_id % 5 + 1 AS VARCHAR) || '}'' AS owner FROM clicks_' || event_type
      || ' WHERE day BETWEEN ''${dt-' || CAST(event_id % 40 AS VARCHAR) || '}'' AND ''${dt}'' AND since >= ''${date-'
      || CAST(event_id % 7 AS VARCHAR) || '}'' AND hour = ''${hr}'' AND batch <> ''${dt}'' AND event = '
      || CAST(event_id AS VARCHAR) || tail AS text,
    tail
  FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN ' -- ${dt-0' || CAST(event_id % 3 AS VARCHAR) || '}'
                       WHEN event_id % 11 = 0 THEN ' /* ${unknown_' || event_type || '} */'
                       ELSE '' END AS tail FROM events) e)"""

SCAN_RE = r"\$\{[A-Za-z_][A-Za-z0-9_.\-]*\}"

DISTINCT_PH = """
ph AS (
  SELECT script_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS d
  FROM (SELECT script_id, regexp_extract_all(text, '""" + SCAN_RE + """') AS a FROM scripts) s)"""

AS_OF_SCRIPT = """
look AS (
  SELECT s.event_id, v.value, v.version,
    row_number() OVER (PARTITION BY s.event_id
      ORDER BY v.effective_at DESC NULLS LAST, v.seq ASC NULLS LAST) AS rn
  FROM scripts s LEFT JOIN project_variables v
    ON v.project_id = s.project_id AND v.name = 'prj.p' || s.k5 AND v.effective_at <= s."at")"""

ORACLES.update({
    "dedup_latest": with_(COMPANY_MAPPING) + """
SELECT v2_company_id, dwi_company_id, update_time, insert_time FROM (
  SELECT m.*, row_number() OVER (PARTITION BY v2_company_id
    ORDER BY update_time DESC NULLS LAST, insert_time DESC NULLS LAST,
             dwi_company_id DESC NULLS LAST) AS rn
  FROM company_mapping m
  WHERE dwi_company_id IS NOT NULL AND dwi_company_id <> ''
    AND v2_company_id IS NOT NULL AND v2_company_id <> '') t
WHERE rn = 1""",

    "change_flag": with_(COMPANY_BASE) + """
SELECT company_id,
  CASE WHEN is_del = '1' THEN '-1'
       WHEN CAST(insert_time AS DATE) = CAST(update_time AS DATE) THEN '1' ELSE '0' END AS isadd
FROM company_base""",

    "biz_date_cols": """
SELECT event_id, strftime(ts, '%Y%m%d') AS dt, strftime(ts, '%Y-%m-%d') AS date,
  strftime(ts, '%Y%m') AS month,
  strftime(CAST(ts AS DATE) - 1, '%Y%m%d') AS dt_1,
  strftime(CAST(ts AS DATE) - 7, '%Y%m%d') AS dt_7,
  strftime(CAST(ts AS DATE) - 365, '%Y%m%d') AS dt_365,
  strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d') AS date_1,
  strftime(CAST(ts AS DATE) - 30, '%Y-%m-%d') AS date_30,
  CASE WHEN regexp_full_match(hr_text, '([01][0-9]|2[0-3])') THEN hr_text END AS hr
FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN '24' ELSE strftime(ts, '%H') END AS hr_text
      FROM events) e""",

    "dated_query": """
SELECT event_type, '20240115' AS biz_dt, '20240114' AS prev_dt, '2024-01-15' AS biz_date,
  '03' AS biz_hr, count(*) AS n_events,
  count(CASE WHEN strftime(ts, '%Y%m%d') = '20240115' THEN 1 END) AS n_on_day,
  count(CASE WHEN strftime(ts, '%Y%m%d') = '20240114' THEN 1 END) AS n_prev_day
FROM events GROUP BY event_type""",

    "backfill_dates": """
SELECT task_id, strftime(s + CAST(k AS INTEGER), '%Y%m%d') AS biz_date, version_choice
FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS task_id,
    DATE '2026-06-01' + CAST(c_custkey % 5 AS INTEGER) AS s,
    CASE WHEN c_acctbal < 0 THEN 'v' || CAST(c_custkey AS VARCHAR) END AS version_choice,
    unnest(range(0, c_nationkey % 7)) AS k
  FROM customer) c""",

    "variable_as_of": with_(PROJECT_VARIABLES, VARIABLE_LOOKUPS) + """
SELECT lookup_id, project_id, name, "at", value, version, matched_effective_at FROM (
  SELECT l.lookup_id, l.project_id, l.name, l."at", v.value, v.version,
    v.effective_at AS matched_effective_at,
    row_number() OVER (PARTITION BY l.lookup_id
      ORDER BY v.effective_at DESC NULLS LAST, v.seq ASC NULLS LAST) AS rn
  FROM variable_lookups l LEFT JOIN project_variables v
    ON v.project_id = l.project_id AND v.name = l.name AND v.effective_at <= l."at") t
WHERE rn = 1""",

    "version_lock": with_(HISTORY, """
inst AS (
  SELECT event_id AS attempt_id,
    CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS instance_id,
    CAST(user_id AS VARCHAR) AS task_id,
    ts - INTERVAL 26 YEAR AS created_at,
    CASE WHEN event_type = 'purchase' THEN event_id END AS explicit_version
  FROM events),
firsts AS (
  SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY instance_id
    ORDER BY created_at, attempt_id) AS rn FROM inst i) t WHERE rn = 1),
look AS (
  SELECT f.instance_id, f.explicit_version, p.version_id,
    row_number() OVER (PARTITION BY f.instance_id
      ORDER BY p.moved_at DESC NULLS LAST, p.rank DESC NULLS LAST, p.id DESC NULLS LAST) AS rn
  FROM firsts f LEFT JOIN history p ON p.task_id = f.task_id AND p.moved_at <= f.created_at)""") + """
SELECT i.instance_id, i.attempt_id, i.task_id, i.created_at, i.explicit_version,
  coalesce(l.explicit_version, l.version_id) AS locked_version,
  CASE WHEN l.explicit_version IS NOT NULL THEN 'explicit'
       WHEN l.version_id IS NOT NULL THEN 'published' ELSE 'none' END AS lock_source
FROM inst i LEFT JOIN look l ON l.instance_id = i.instance_id AND l.rn = 1""",

    "placeholder_scan": with_(SCRIPTS, DISTINCT_PH) + """
SELECT script_id, array_to_string(d, ' ') AS placeholders, CAST(len(d) AS BIGINT) AS n_placeholders
FROM ph""",

    "pattern_match": with_(SCRIPTS, DISTINCT_PH) + r"""
SELECT script_id, CAST(i - 1 AS BIGINT) AS pos, p AS placeholder,
  CASE WHEN regexp_full_match(p, '\$\{dt\}') THEN 'dt'
       WHEN regexp_full_match(p, '\$\{date\}') THEN 'date'
       WHEN regexp_full_match(p, '\$\{month\}') THEN 'month'
       WHEN regexp_full_match(p, '\$\{dt-([1-9][0-9]*|0)\}') THEN 'dt-N'
       WHEN regexp_full_match(p, '\$\{date-([1-9][0-9]*|0)\}') THEN 'date-N'
       WHEN regexp_full_match(p, '\$\{hr\}') THEN 'hr' END AS variable
FROM (SELECT script_id, unnest(d) AS p, unnest(range(1, len(d) + 1)) AS i FROM ph) t""",

    "render_templates": with_(SCRIPTS) + """
SELECT script_id,
  CASE WHEN biz_hour IS NULL THEN NULL ELSE
    replace(replace(replace(replace(replace(replace(text,
      '${dt}', strftime(dd, '%Y%m%d')),
      '${hr}', biz_hour),
      '${dt-' || CAST(k40 AS VARCHAR) || '}', strftime(dd - k40, '%Y%m%d')),
      '${date-' || CAST(k7 AS VARCHAR) || '}', strftime(dd - k7, '%Y-%m-%d')),
      '${month}', strftime(dd, '%Y%m')),
      '${date}', strftime(dd, '%Y-%m-%d')) END AS rendered,
  CASE WHEN event_id % 9 = 0 THEN '${dt-0' || CAST(event_id % 3 AS VARCHAR) || '}, ${prj.p' || k5 || '}'
       WHEN event_id % 11 = 0 THEN '${prj.p' || k5 || '}, ${unknown_' || event_type || '}'
       ELSE '${prj.p' || k5 || '}' END AS unresolved,
  CASE WHEN biz_hour IS NULL THEN 'no business hour for ${hr}' END AS error
FROM scripts""",

    "bake_templates": with_(PROJECT_VARIABLES, SCRIPTS, AS_OF_SCRIPT) + """
SELECT s.script_id,
  CASE WHEN l.value IS NULL OR s.tail <> '' THEN NULL
       ELSE replace(s.text, '${prj.p' || s.k5 || '}', l.value) END AS baked,
  CASE WHEN l.value IS NULL THEN '' ELSE 'prj.p' || s.k5 || '=' || CAST(l.version AS VARCHAR) END AS var_versions,
  array_to_string(list_sort(list_filter([
      CASE WHEN s.event_id % 9 = 0 THEN '${dt-0' || CAST(s.event_id % 3 AS VARCHAR) || '}' END,
      CASE WHEN l.value IS NULL THEN '${prj.p' || s.k5 || '}' END,
      CASE WHEN s.event_id % 9 <> 0 AND s.event_id % 11 = 0 THEN '${unknown_' || s.event_type || '}' END],
    lambda x: x IS NOT NULL)), ', ') AS unresolved
FROM scripts s JOIN look l ON l.event_id = s.event_id AND l.rn = 1""",

    "unresolved_vars": with_(PROJECT_VARIABLES, SCRIPTS, AS_OF_SCRIPT) + """
SELECT script_id, '${dt-0' || CAST(event_id % 3 AS VARCHAR) || '}' AS placeholder
FROM scripts WHERE event_id % 9 = 0
UNION ALL
SELECT script_id, '${unknown_' || event_type || '}' FROM scripts
WHERE event_id % 9 <> 0 AND event_id % 11 = 0
UNION ALL
SELECT s.script_id, '${prj.p' || s.k5 || '}' FROM scripts s
JOIN look l ON l.event_id = s.event_id AND l.rn = 1 WHERE l.value IS NULL""",
})

from batchwright.plans.standins import CONF_KEYS as _CONF_KEYS  # noqa: E402  (input data, not logic)

_CONF_LIST = "[" + ", ".join(f"'{k}'" for k in _CONF_KEYS) + "]"

LOG_LINES = """
log_lines AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS instance_id,
    concat_ws(' ', '[driver] run statement',
      'trace_id=trace-' || CAST(user_id AS VARCHAR),
      'instance_id=' || CAST(user_id AS VARCHAR),
      'version_id=v' || CAST(event_id % 7 AS VARCHAR),
      'task_id=task-' || CAST(user_id % 10 AS VARCHAR),
      'biz_date=' || strftime(ts, '%Y%m%d'),
      'biz_hour=' || strftime(ts, '%H'),
      'timezone=Asia/Shanghai',
      CASE WHEN event_type <> 'signup' THEN 'application_id=application_'
        || CAST(event_id AS VARCHAR) || '_' || CAST(user_id AS VARCHAR) END,
      'stmt=' || CAST(event_id % 5 + 1 AS VARCHAR) || '/5',
      CASE WHEN event_type = 'error' THEN '--keytab /etc/security/keytabs/u'
        || CAST(user_id AS VARCHAR) || '.keytab' END) AS line,
    event_type, user_id
  FROM events)"""

ORACLES.update({
    "policy_check": """
SELECT task_id, key, value,
  CASE WHEN key IN ('spark.driver.extraJavaOptions', 'spark.executor.extraJavaOptions',
                    'spark.driver.extraClassPath', 'spark.driver.extraLibraryPath',
                    'spark.executor.extraClassPath', 'spark.executor.extraLibraryPath',
                    'spark.yarn.principal', 'spark.yarn.keytab')
         OR starts_with(key, 'spark.yarn.dist.') OR starts_with(key, 'spark.kerberos.')
         OR starts_with(key, 'spark.security.credentials.') THEN 'blacklisted'
       WHEN key IN ('spark.executor.cores', 'spark.driver.cores')
         OR starts_with(key, 'spark.sql.') OR starts_with(key, 'spark.shuffle.')
         OR starts_with(key, 'spark.dynamicAllocation.') OR starts_with(key, 'spark.executor.memory')
         OR starts_with(key, 'spark.driver.memory') OR starts_with(key, 'spark.yarn.appMasterEnv.')
         OR starts_with(key, 'spark.executorEnv.')
         OR starts_with(key, 'spark.hadoop.hive.exec.dynamic.partition') THEN 'accepted'
       ELSE 'not in whitelist' END AS verdict
FROM (SELECT p_brand AS task_id, """ + _CONF_LIST + """[p_partkey % 24 + 1] AS key,
        p_name AS value FROM part) c""",

    "log_parse": with_(LOG_LINES) + """
SELECT event_id, '[driver] run statement' AS prefix,
  'trace-' || CAST(user_id AS VARCHAR) AS trace_id,
  CAST(user_id AS VARCHAR) AS instance_id,
  'v' || CAST(event_id % 7 AS VARCHAR) AS version_id,
  'task-' || CAST(user_id % 10 AS VARCHAR) AS task_id,
  strftime(ts, '%Y%m%d') AS biz_date, strftime(ts, '%H') AS biz_hour,
  'Asia/Shanghai' AS timezone,
  CASE WHEN event_type <> 'signup' THEN 'application_' || CAST(event_id AS VARCHAR) || '_'
    || CAST(user_id AS VARCHAR) END AS application_id,
  CAST(event_id % 5 + 1 AS INTEGER) AS stmt_index, 5 AS stmt_total
FROM log_lines""",

    "first_app_id": with_(LOG_LINES) + """
SELECT instance_id, coalesce(max(CASE WHEN rn = 1 AND app <> '' THEN app END), '') AS application_id
FROM (SELECT instance_id, regexp_extract(line, 'application_[0-9]+_[0-9]+') AS app,
        row_number() OVER (PARTITION BY instance_id ORDER BY
          CASE WHEN regexp_extract(line, 'application_[0-9]+_[0-9]+') <> '' THEN 0 ELSE 1 END,
          ts, event_id) AS rn
      FROM log_lines) t
GROUP BY instance_id""",

    "redact_paths": with_(LOG_LINES) + """
SELECT event_id, regexp_replace(line, '[^ =''"]+\\.keytab', '***', 'g') AS line FROM log_lines""",

    "content_digest": """
SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size
FROM documents""",

    "snapshot_roundtrip": """
SELECT doc_id, lang, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size
FROM documents""",

    "manifest_read": """
SELECT 'prod' AS env, 'documents' AS task_id, 'v1' AS version_id, 'r1' AS draft_revision_id,
  'batch' AS baked_by, count(*) AS n_rows,
  CAST(sum(octet_length(encode(text))) AS BIGINT) AS byte_size, 'ok' AS status,
  3 AS prj_p1_version
FROM documents""",

    "valid_segments": """
SELECT page_id, segment,
  regexp_full_match(segment, '[A-Za-z0-9._-]+') AND NOT regexp_full_match(segment, '\\.+') AS ok
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS segment FROM pages) p""",

    "table_overwrite": """
SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, upper(o_orderpriority) AS o_orderpriority
FROM orders""",

    "partition_overwrite": """
SELECT event_id,
  CASE WHEN dt = '20240115' AND hr = '03' THEN upper(event_type) ELSE event_type END AS event_type,
  CASE WHEN dt = '20240115' AND hr = '03' THEN value * 2 ELSE value END AS value, dt, hr
FROM (SELECT event_id, event_type, value, strftime(ts, '%Y%m%d') AS dt, strftime(ts, '%H') AS hr
      FROM events) e""",

    "partition_append": """
SELECT dt, m, count(*) + CASE WHEN dt = '20240115' THEN count(*) ELSE 0 END AS n_rows,
  count(DISTINCT event_id) AS n_ids
FROM (SELECT event_id, strftime(ts, '%Y%m%d') AS dt, strftime(ts, '%Y%m') AS m FROM events) e
GROUP BY dt, m""",

    "rows_append": """
SELECT event_id, strftime(ts, '%H') AS hr FROM events
UNION ALL SELECT -1 AS event_id, '03' AS hr""",

    "month_archive": """
SELECT strftime(o_orderdate, '%Y%m') AS m, count(*) AS n_rows,
  count(CASE WHEN o_orderdate < TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 365 DAY THEN 1 END) AS n_expired
FROM orders GROUP BY 1""",
})

TRIGGERS = """
triggers AS (
  SELECT event_id AS instance_id, 'task-' || CAST(user_id % 20 AS VARCHAR) AS task_id,
    strftime(ts, '%Y%m%d') AS biz_date,
    CASE WHEN event_type = 'signup' THEN 'backfill' ELSE 'schedule' END AS trigger_source,
    CASE WHEN event_type <> 'signup' THEN date_trunc('hour', ts) END AS scheduled_at, ts AS created_at,
    CAST(user_id % 10 AS VARCHAR) AS tenant_id
  FROM events)"""

_LEGAL = """(prev_state, state) IN (
  ('start', 'pending'), ('pending', 'waiting_dependency'), ('pending', 'submitting'),
  ('waiting_dependency', 'submitting'), ('waiting_dependency', 'killed'),
  ('submitting', 'submit_failed'), ('submitting', 'running'), ('running', 'succeeded'),
  ('running', 'failed'), ('running', 'killed'), ('submit_failed', 'submitting'),
  ('failed', 'submitting'))"""


# One event after another: a rejected one leaves the state as it was.
_REPLAY = "WITH RECURSIVE " + INSTANCE_EVENTS.strip() + """,
numbered AS (
  SELECT event_id, instance_id, state, row_number() OVER (PARTITION BY instance_id ORDER BY ts, event_id) AS n
  FROM instance_events),
edges(a, b) AS (VALUES
  ('start', 'pending'), ('pending', 'waiting_dependency'), ('pending', 'submitting'),
  ('waiting_dependency', 'submitting'), ('waiting_dependency', 'killed'),
  ('submitting', 'submit_failed'), ('submitting', 'running'), ('running', 'succeeded'),
  ('running', 'failed'), ('running', 'killed'), ('submit_failed', 'submitting'),
  ('failed', 'submitting')),
walk AS (
  SELECT event_id, instance_id, state, n, 'start' AS from_state, coalesce(state = 'pending', false) AS legal,
    CASE WHEN state = 'pending' THEN 'pending' ELSE 'start' END AS true_state
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.event_id, x.instance_id, x.state, x.n, w.true_state,
    EXISTS (SELECT 1 FROM edges e WHERE e.a = w.true_state AND e.b = x.state),
    CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.a = w.true_state AND e.b = x.state) THEN x.state ELSE w.true_state END
  FROM walk w JOIN numbered x ON x.instance_id = w.instance_id AND x.n = w.n + 1)
"""


ORACLES.update({
    "transition_audit": with_(INSTANCE_EVENTS) + """
SELECT prev_state, state, """ + _LEGAL + """ AS legal, count(*) AS n
FROM (SELECT coalesce(lag(state) OVER (PARTITION BY instance_id ORDER BY ts, event_id), 'start') AS prev_state,
        state FROM instance_events) t
GROUP BY 1, 2, 3""",

    "current_state": with_(INSTANCE_EVENTS) + """
SELECT instance_id, arg_max(state, (ts, event_id)) AS current_state, count(*) AS n_events
FROM instance_events GROUP BY instance_id""",

    "state_replay": _REPLAY + """
SELECT event_id, instance_id, from_state, state, legal, true_state FROM walk""",

    "true_state": _REPLAY + """
SELECT instance_id, arg_max(true_state, n) AS true_state, count(*) AS n_events,
  count(CASE WHEN NOT legal THEN 1 END) AS n_rejected
FROM walk GROUP BY instance_id""",

    "published_pointer": with_(HISTORY, """
steps AS (
  SELECT * FROM history
  UNION ALL SELECT task_id, baked_at, 0, version_id, version_id, 'bake' FROM task_versions WHERE status = 'baked')""") + """
SELECT s.task_id, s.moved_at AS event_at, s.kind, s.version_id,
  arg_max(h.version_id, (h.moved_at, h.rank, h.id)) AS pointer
FROM steps s LEFT JOIN history h
  ON h.task_id = s.task_id AND (h.moved_at, h.rank, h.id) <= (s.moved_at, s.rank, s.id)
GROUP BY s.task_id, s.moved_at, s.kind, s.version_id, s.rank, s.id""",

    "peak_running": with_(RUNS) + """
SELECT tenant_id, CAST(max(running) AS BIGINT) AS peak_running FROM (
  SELECT tenant_id, sum(d) OVER (PARTITION BY tenant_id ORDER BY t, d, event_id
                                 ROWS UNBOUNDED PRECEDING) AS running
  FROM (SELECT tenant_id, started_at AS t, 1 AS d, event_id FROM runs
        UNION ALL
        SELECT tenant_id, ended_at AS t, -1 AS d, event_id FROM runs WHERE ended_at IS NOT NULL) x) y
GROUP BY tenant_id""",

    "sla_breaches": with_(RUNS) + """
SELECT event_id, instance_id, run_s, ended_at IS NULL AS still_running FROM (
  SELECT *, (epoch_us(coalesce(ended_at, TIMESTAMP '2024-02-01 00:00:00'))
             - epoch_us(started_at)) // 1000000 AS run_s FROM runs) r
WHERE run_s > 1800""",

    "trigger_dedupe": with_(TRIGGERS) + """
SELECT instance_id, task_id, biz_date, trigger_source, first_instance_id,
  instance_id <> first_instance_id AS is_duplicate
FROM (SELECT *, first_value(instance_id) OVER (PARTITION BY task_id, biz_date, trigger_source, scheduled_at
        ORDER BY created_at, instance_id) AS first_instance_id FROM triggers) t""",

    "instance_filter": with_(TRIGGERS) + """
SELECT instance_id, task_id, tenant_id, created_at FROM triggers
WHERE trigger_source = 'backfill' AND tenant_id IN ('1', '2')
  AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",

    "dependency_ready": """
WITH inst AS (
  SELECT user_id AS task_id, CAST(ts AS DATE) AS biz_date, bool_or(event_type = 'purchase') AS ok
  FROM events GROUP BY 1, 2),
tasks AS (SELECT DISTINCT user_id AS task_id FROM events),
deps AS (
  SELECT task_id, task_id - 1 AS upstream_id, CAST(task_id % 3 AS INTEGER) AS off FROM tasks WHERE task_id >= 1
  UNION ALL
  SELECT task_id, task_id - 2, CAST(task_id % 3 AS INTEGER) FROM tasks WHERE task_id >= 2),
need AS (
  SELECT i.task_id, i.biz_date, d.upstream_id, i.biz_date - d.off AS uday
  FROM inst i LEFT JOIN deps d ON d.task_id = i.task_id)
SELECT n.task_id, n.biz_date, count(n.upstream_id) AS n_deps,
  coalesce(bool_and(CASE WHEN n.upstream_id IS NOT NULL THEN coalesce(u.ok, false) END), true) AS ready,
  CASE WHEN coalesce(bool_and(CASE WHEN n.upstream_id IS NOT NULL THEN coalesce(u.ok, false) END), true)
       THEN 'submitting' ELSE 'waiting_dependency' END AS state
FROM need n LEFT JOIN inst u ON u.task_id = n.upstream_id AND u.biz_date = n.uday
GROUP BY n.task_id, n.biz_date""",

    "registry_reconcile": """
WITH a AS (SELECT nullif(c_custkey, 7) AS key, count(*) AS n FROM customer GROUP BY 1),
b AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderkey % 11 = 0 THEN o_custkey + 100000
                  ELSE o_custkey END AS key, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key,
  CASE WHEN a.n IS NULL THEN 'orphan' WHEN b.n IS NULL THEN 'unsynced' ELSE 'both' END AS status,
  coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b
FROM a FULL OUTER JOIN b ON a.key IS NOT DISTINCT FROM b.key""",

    "run_compare": """
WITH x AS (SELECT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS k, l_linenumber AS line, l_partkey AS part,
             nullif(l_linestatus, 'O') AS mode FROM lineitem),
y AS (SELECT CASE WHEN k % 13 = 0 THEN k + 1000000 ELSE k END AS k, line,
        CASE WHEN k % 10 = 0 THEN part + 1 ELSE part END AS part,
        CASE WHEN k % 15 = 0 THEN NULL ELSE mode END AS mode FROM x),
a AS (SELECT k, line, count(*) AS n, list_sort(list(CAST(part AS VARCHAR))) AS part,
        list_sort(list(coalesce(mode, '-'))) AS mode FROM x GROUP BY 1, 2),
b AS (SELECT k, line, count(*) AS n, list_sort(list(CAST(part AS VARCHAR))) AS part,
        list_sort(list(coalesce(mode, '-'))) AS mode FROM y GROUP BY 1, 2),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.line, b.line) AS line, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new,
        concat_ws(',', CASE WHEN a.n <> b.n THEN '*' END, CASE WHEN a.mode <> b.mode THEN 'mode' END,
                  CASE WHEN a.part <> b.part THEN 'part' END) AS diff
      FROM a FULL OUTER JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.line = b.line)
SELECT k, line, CASE WHEN n_old = 0 THEN 'only_new' WHEN n_new = 0 THEN 'only_old'
    WHEN diff <> '' THEN 'changed' ELSE 'same' END AS status, diff AS changed_cols, n_old, n_new
FROM j""",

    "run_compare_repeated": """
WITH a AS (SELECT l_orderkey AS k, count(*) AS n, list_sort(list(l_partkey)) AS part FROM lineitem GROUP BY 1),
b AS (SELECT CASE WHEN l_partkey % 50 <> 0 THEN l_orderkey END AS k, count(*) AS n, list_sort(list(l_partkey)) AS part
      FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new,
        concat_ws(',', CASE WHEN a.n <> b.n THEN '*' END, CASE WHEN a.part <> b.part THEN 'part' END) AS diff
      FROM a FULL OUTER JOIN b ON a.k IS NOT DISTINCT FROM b.k)
SELECT k, CASE WHEN n_old = 0 THEN 'only_new' WHEN n_new = 0 THEN 'only_old'
    WHEN diff <> '' THEN 'changed' ELSE 'same' END AS status, diff AS changed_cols, n_old, n_new
FROM j""",

    "lineage_walk": """
SELECT e.event_id, e.event_id AS version_id, 'r' || CAST(v.o_orderkey AS VARCHAR) AS draft_revision_id,
  'author-' || CAST(d.o_custkey % 100 AS VARCHAR) AS author,
  d.o_custkey AS task_id, c.c_nationkey AS project_id, n.n_name AS project_name
FROM events e LEFT JOIN orders v ON v.o_orderkey = e.event_id
LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') d ON d.o_orderkey = v.o_orderkey
LEFT JOIN customer c ON c.c_custkey = d.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""",

    "trace_rows": with_(LOG_LINES, RUNS) + """
SELECT 'trace-' || instance_id AS trace_id, ts, 'driver' AS layer, line AS detail FROM log_lines
UNION ALL SELECT trace_id, ts, 'instance', state FROM instance_events
UNION ALL SELECT trace_id, ended_at, 'run', 'ended ' || state FROM runs WHERE ended_at IS NOT NULL""",

    "run_metrics": with_(RUNS) + """
SELECT tenant_id, count(*) AS n_runs, count(*) FILTER (WHERE state = 'succeeded') AS n_succeeded,
  count(*) FILTER (WHERE state = 'succeeded') / count(*) AS success_rate,
  quantile_disc(duration_s, 0.5) AS p50_s, quantile_disc(duration_s, 0.95) AS p95_s, quantile_disc(duration_s, 0.99) AS p99_s
FROM runs GROUP BY tenant_id""",

    "retry_stats": with_(INSTANCE_EVENTS) + """,
again AS (
  SELECT DISTINCT f.instance_id FROM instance_events f JOIN instance_events g
    ON g.instance_id = f.instance_id AND f.state IN ('failed', 'submit_failed') AND g.state = 'succeeded'
   AND (g.ts, g.event_id) > (f.ts, f.event_id))
SELECT t.instance_id, n_attempts, n_failures, succeeded,
  greatest(n_attempts - 1, 0) AS retries,
  greatest(n_attempts - 1, 0) >= 2 AND NOT succeeded AS exhausted,
  again.instance_id IS NOT NULL AS recovered
FROM (SELECT instance_id, count(CASE WHEN state = 'submitting' THEN 1 END) AS n_attempts,
        count(CASE WHEN state IN ('failed', 'submit_failed') THEN 1 END) AS n_failures,
        coalesce(bool_or(state = 'succeeded'), false) AS succeeded
      FROM instance_events GROUP BY instance_id) t LEFT JOIN again ON again.instance_id = t.instance_id""",

    "trace_coverage": with_(LOG_LINES) + """
SELECT 'task-' || CAST(user_id % 10 AS VARCHAR) AS task_id, count(DISTINCT instance_id) AS n_instances,
  count(DISTINCT CASE WHEN contains(line, 'trace_id=trace-') THEN instance_id END) AS n_present,
  count(DISTINCT CASE WHEN contains(line, 'trace_id=trace-') THEN instance_id END) / count(DISTINCT instance_id) AS coverage
FROM log_lines GROUP BY 1""",

    "application_coverage": with_(LOG_LINES) + """
SELECT 'task-' || CAST(user_id % 10 AS VARCHAR) AS task_id, count(*) AS n_rows,
  count(CASE WHEN event_type <> 'signup' THEN 1 END) AS n_present,
  count(CASE WHEN event_type <> 'signup' THEN 1 END) / count(*) AS coverage
FROM log_lines GROUP BY 1""",

    "daily_counts": with_(INSTANCE_EVENTS) + """
SELECT tenant_id, CAST(ts AS DATE) AS day, count(DISTINCT instance_id) AS n_instances, count(*) AS n_events
FROM instance_events GROUP BY 1, 2""",

    "first_publish": """
SELECT o_custkey AS task_id, o_orderstatus AS revision, o_orderpriority AS idem_key,
  arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_result, count(*) AS n_requests
FROM orders GROUP BY 1, 2, 3""",

    "audit_diff": """
WITH texts AS (
  SELECT event_id AS id,
    CASE WHEN event_id % 14 = 0 THEN '{"k": null}' WHEN event_id % 15 = 0 THEN NULL ELSE props END AS b,
    CASE WHEN event_id % 6 = 0 THEN '{"t": "' || event_type || '"}'
         WHEN event_id % 10 = 0 THEN '{"k": null, "t": "' || event_type || '"}'
         WHEN event_id % 21 = 0 THEN '{"k": '
         WHEN event_id % 4 = 0 THEN '{"k": ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS VARCHAR)
           || ', "t": "' || event_type || '"}'
         ELSE '{"k": ' || json_extract_string(props, '$.k') || ', "t": "' || event_type || '"}' END AS a
  FROM events),
judged AS (SELECT *, coalesce(NOT json_valid(b), false) OR coalesce(NOT json_valid(a), false) AS bad FROM texts),
sides AS (
  SELECT id, coalesce(CAST(b AS JSON), '{}') AS b, coalesce(CAST(a AS JSON), '{}') AS a FROM judged WHERE NOT bad),
fields AS (
  SELECT *, unnest(list_distinct(list_concat(json_keys(b), json_keys(a)))) AS field FROM sides),
rows AS (
  SELECT id, field, json_extract_string(b, '$.' || field) AS before, json_extract_string(a, '$.' || field) AS after,
    CASE WHEN NOT list_contains(json_keys(b), field) THEN 'added'
         WHEN NOT list_contains(json_keys(a), field) THEN 'removed'
         WHEN json_extract_string(b, '$.' || field) IS DISTINCT FROM json_extract_string(a, '$.' || field) THEN 'changed'
    END AS change
  FROM fields)
SELECT id, field, before, after, change FROM rows WHERE change IS NOT NULL
UNION ALL SELECT id, NULL, b, a, 'malformed' FROM judged WHERE bad""",

    "adapter_metrics": """
SELECT 'call-' || event_type AS operation, count(*) AS n_calls,
  count(*) FILTER (WHERE value < 1 OR value IS NULL OR (event_type = 'error' AND value > 45)) AS n_errors,
  count(*) FILTER (WHERE value < 1 OR value IS NULL OR (event_type = 'error' AND value > 45)) / count(*) AS error_rate
FROM events GROUP BY 1""",

    "instance_by_app_id": """
SELECT event_id AS instance_id, 'task-' || CAST(user_id % 20 AS VARCHAR) AS task_id, 'application_3' AS application_id
FROM events WHERE user_id % 10 = 3""",

    "partition_overwrite_empty": """
SELECT event_id, event_type, value, strftime(ts, '%Y%m%d') AS dt, strftime(ts, '%H') AS hr
FROM events WHERE NOT (strftime(ts, '%Y%m%d') = '20240115' AND strftime(ts, '%H') = '03')""",

    "pruned_day": """
SELECT event_type, count(*) AS n_events FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1""",
})

ORACLES["lint_report"] = with_(PROJECT_VARIABLES, SCRIPTS, AS_OF_SCRIPT) + """,
unresolved AS (
  SELECT script_id, '${dt-0' || CAST(event_id % 3 AS VARCHAR) || '}' AS placeholder
  FROM scripts WHERE event_id % 9 = 0
  UNION ALL
  SELECT script_id, '${unknown_' || event_type || '}' FROM scripts
  WHERE event_id % 9 <> 0 AND event_id % 11 = 0
  UNION ALL
  SELECT s.script_id, '${prj.p' || s.k5 || '}' FROM scripts s
  JOIN look l ON l.event_id = s.event_id AND l.rn = 1 WHERE l.value IS NULL),
policy AS (""" + ORACLES["policy_check"] + """),
segs AS (""" + ORACLES["valid_segments"] + """)
SELECT 'script' AS subject_type, CAST(script_id AS VARCHAR) AS subject_id,
  'unresolved_variable' AS rule, placeholder AS detail FROM unresolved
UNION ALL
SELECT 'script', CAST(script_id AS VARCHAR), 'render_error', 'no business hour for ${hr}'
FROM scripts WHERE biz_hour IS NULL
UNION ALL
SELECT 'task', task_id, 'conf_rejected', key || ': ' || verdict FROM policy WHERE verdict <> 'accepted'
UNION ALL
SELECT 'page', CAST(page_id AS VARCHAR), 'bad_segment', segment FROM segs WHERE NOT ok
UNION ALL
SELECT 'backfill', CAST(c_custkey AS VARCHAR), 'bad_range', 'range ends '
  || strftime(DATE '2026-06-01' + CAST(c_custkey % 5 AS INTEGER) - 1, '%Y-%m-%d') || ' before its start '
  || strftime(DATE '2026-06-01' + CAST(c_custkey % 5 AS INTEGER), '%Y-%m-%d')
FROM customer WHERE c_nationkey % 7 = 0"""

ORACLES["trigger_latency"] = with_(TRIGGERS) + """,
lat AS (SELECT tenant_id, (epoch_us(created_at) - epoch_us(scheduled_at)) // 1000000 AS latency_s
        FROM triggers)
SELECT tenant_id, count(*) AS n_triggers, quantile_disc(latency_s, 0.5) AS p50_s,
  quantile_disc(latency_s, 0.95) AS p95_s, quantile_disc(latency_s, 0.99) AS p99_s
FROM lat GROUP BY tenant_id"""

ORACLES["run_histogram"] = with_(RUNS) + """
SELECT tenant_id,
  CAST(CASE WHEN duration_s < 0 THEN 0 WHEN duration_s >= 3600 THEN 13
            ELSE floor(duration_s / 300) + 1 END AS BIGINT) AS bucket,
  count(*) AS n_runs
FROM runs GROUP BY 1, 2"""

ORACLES["insert_overwrite_partition"] = """
SELECT event_id AS click_id,
  CASE WHEN day = '20240115' AND hour = '03' THEN 'reload of 2024-01-15' ELSE 'first load' END AS note, day, hour
FROM (SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%H') AS hour FROM events) e"""

ORACLES["preview_templates"] = with_(PROJECT_VARIABLES, SCRIPTS, AS_OF_SCRIPT, """
b AS (
  SELECT s.script_id, s.event_id, s.biz_hour, s.dd, s.k40, s.k7,
    replace(s.text, '${prj.p' || s.k5 || '}', l.value) AS baked,
    array_to_string(list_sort(list_filter([
        CASE WHEN s.event_id % 9 = 0 THEN '${dt-0' || CAST(s.event_id % 3 AS VARCHAR) || '}' END,
        CASE WHEN l.value IS NULL THEN '${prj.p' || s.k5 || '}' END,
        CASE WHEN s.event_id % 9 <> 0 AND s.event_id % 11 = 0 THEN '${unknown_' || s.event_type || '}' END],
      lambda x: x IS NOT NULL)), ', ') AS unresolved
  FROM scripts s JOIN look l ON l.event_id = s.event_id AND l.rn = 1)""") + """
SELECT script_id,
  CASE WHEN unresolved = '' AND biz_hour IS NOT NULL THEN
    replace(replace(replace(replace(replace(replace(baked,
      '${dt}', strftime(dd, '%Y%m%d')),
      '${hr}', biz_hour),
      '${dt-' || CAST(k40 AS VARCHAR) || '}', strftime(dd - k40, '%Y%m%d')),
      '${date-' || CAST(k7 AS VARCHAR) || '}', strftime(dd - k7, '%Y-%m-%d')),
      '${month}', strftime(dd, '%Y%m')),
      '${date}', strftime(dd, '%Y-%m-%d')) END AS preview,
  CASE WHEN unresolved <> '' THEN 'publish blocked - unknown placeholders: ' || unresolved
       WHEN biz_hour IS NULL THEN 'no business hour for ${hr}' END AS error
FROM b"""

PUBLISHES = """
publishes AS (
  SELECT o_orderkey AS publish_id, CAST(o_custkey AS VARCHAR) AS task_id,
    CAST(o_custkey % 10 AS VARCHAR) AS project_id, o_orderdate AS requested_at,
    CAST(floor(o_totalprice) AS BIGINT) % 9000 AS duration_ms,
    CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'published' END AS outcome
  FROM orders)"""

ORACLES["publish_metrics"] = with_(PUBLISHES) + """
SELECT project_id, count(*) AS n_publishes, count(*) FILTER (WHERE outcome = 'published') AS n_published,
  count(*) FILTER (WHERE outcome = 'published') / count(*) AS success_rate,
  quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms,
  quantile_disc(duration_ms, 0.99) AS p99_ms
FROM publishes GROUP BY project_id"""

ORACLES["publish_histogram"] = with_(PUBLISHES) + """
SELECT project_id,
  CAST(CASE WHEN duration_ms < 0 THEN 0 WHEN duration_ms >= 10000 THEN 11
            ELSE floor(duration_ms / 1000) + 1 END AS BIGINT) AS bucket,
  count(*) AS n_publishes
FROM publishes GROUP BY 1, 2"""

ORACLES["retry_success"] = "WITH s AS (" + ORACLES["retry_stats"] + """)
SELECT count(CASE WHEN n_failures > 0 THEN 1 END) AS n_failed,
  count(CASE WHEN recovered THEN 1 END) AS n_recovered, count(CASE WHEN exhausted THEN 1 END) AS n_exhausted,
  CASE WHEN count(CASE WHEN n_failures > 0 THEN 1 END) > 0
       THEN count(CASE WHEN recovered THEN 1 END) / count(CASE WHEN n_failures > 0 THEN 1 END) END AS retry_success_rate
FROM s"""

ORACLES["task_policy"] = "WITH policy AS (" + ORACLES["policy_check"] + """)
SELECT task_id, count(*) AS n_keys,
  array_to_string(list_sort(list_distinct(list(
    CASE WHEN verdict <> 'accepted' THEN key || ': ' || verdict END))), ', ') AS rejected,
  array_to_string(list_sort(list_distinct(list(
    CASE WHEN verdict <> 'accepted' THEN key || ': ' || verdict END))), ', ') = '' AS accepted
FROM policy GROUP BY task_id"""


ORACLES.update({
    "policy_rules": """
WITH rules AS (
  SELECT CAST(p_size % 10 AS VARCHAR) AS t, 'allow' AS effect, 'prefix' AS match, substr(p_name, 1, 4) AS pattern FROM part WHERE p_size % 3 <> 0
  UNION SELECT CAST(p_size % 10 AS VARCHAR), 'allow', 'key', p_name FROM part WHERE p_size % 3 = 0
  UNION SELECT CAST(p_size % 10 AS VARCHAR), 'deny', 'prefix', split_part(p_name, ' ', 1) || ' ' FROM part WHERE p_size % 7 = 0
  UNION SELECT CAST(p_size % 10 AS VARCHAR), 'deny', 'key', p_name FROM part WHERE p_size % 11 = 0),
conf AS (SELECT p_partkey, CAST(p_partkey % 10 AS VARCHAR) AS tenant_id, p_name AS key FROM part),
hits AS (
  SELECT c.p_partkey, r.effect FROM conf c JOIN rules r ON r.t = c.tenant_id
    AND CASE r.match WHEN 'key' THEN r.pattern = c.key ELSE starts_with(c.key, r.pattern) END)
SELECT p_partkey, tenant_id, key,
  CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.p_partkey = c.p_partkey AND effect = 'deny') THEN 'blacklisted'
       WHEN EXISTS (SELECT 1 FROM hits h WHERE h.p_partkey = c.p_partkey) THEN 'accepted' ELSE 'not in whitelist' END AS verdict
FROM conf c""",

    "catalog_match": with_(SCRIPTS, r"""
names AS (
  SELECT script_id, "at", unnest(list_distinct(regexp_extract_all(text, '\$\{[A-Za-z_][A-Za-z0-9_.\-]*\}'))) AS placeholder
  FROM scripts)""") + r"""
SELECT script_id, "at", placeholder,
  CASE WHEN placeholder IN ('${dt}', '${date}', '${month}', '${hr}') THEN substr(placeholder, 3, length(placeholder) - 3)
       WHEN regexp_full_match(placeholder, '\$\{dt-([1-9][0-9]*|0)\}') THEN 'dt-N'
       WHEN regexp_full_match(placeholder, '\$\{date-([1-9][0-9]*|0)\}') THEN 'date-N'
       WHEN starts_with(placeholder, '${unknown_') THEN 'unknown-' || substr(placeholder, 11, length(placeholder) - 11)
       WHEN regexp_full_match(placeholder, '\$\{prj\.p[0-9]\}') THEN 'project'
       WHEN regexp_full_match(placeholder, '\$\{(dt|date)-0[0-9]+\}') THEN 'bad offset' END AS variable
FROM names""",

    "running_between": with_(RUNS) + """
SELECT r.event_id, o.o_orderkey AS range_id, r.tenant_id
FROM runs r JOIN orders o ON r.tenant_id = CAST(o.o_custkey % 10 AS VARCHAR)
  AND r.started_at < o.o_orderdate + INTERVAL 26 YEAR + INTERVAL 30 MINUTE
  AND coalesce(r.ended_at, TIMESTAMP '2024-02-01 00:00:00') >= o.o_orderdate + INTERVAL 26 YEAR
  AND coalesce(r.ended_at, TIMESTAMP '2024-02-01 00:00:00') >= r.started_at""",

    "concurrency_by_minute": with_(RUNS) + """
SELECT tenant_id, minute, CAST(sum(d) OVER (PARTITION BY tenant_id ORDER BY minute) AS BIGINT) AS running
FROM (
  SELECT tenant_id, minute, sum(d) AS d FROM (
    SELECT tenant_id, date_trunc('minute', started_at) AS minute, 1 AS d FROM runs
    UNION ALL
    SELECT tenant_id, date_trunc('minute', ended_at) + INTERVAL 1 MINUTE, -1 FROM runs WHERE ended_at IS NOT NULL) s
  GROUP BY ALL HAVING sum(s.d) <> 0) x""",
})


# Step by step along the blockers, with the instances passed; a cycle's name is the
# smallest instance from the first repeated one on.
ORACLES["waiting_causes"] = """
WITH RECURSIVE inst AS (
  SELECT user_id % 20 AS t, CAST(ts AS DATE) AS d, bool_or(event_type = 'purchase' AND value > 45) AS ok FROM events GROUP BY 1, 2),
tasks AS (SELECT DISTINCT t FROM inst),
deps AS (
  SELECT t, t - 1 AS up, 0 AS off FROM tasks WHERE t % 5 <> 0
  UNION SELECT t, t, 1 FROM tasks WHERE t % 5 = 0
  UNION SELECT t, t + 1, 0 FROM tasks WHERE t % 10 = 3
  UNION SELECT t, t - 1, 0 FROM tasks WHERE t % 10 = 4
  UNION SELECT t, t + 1, 0 FROM tasks WHERE t = 19),
blocked AS (
  SELECT i.t, i.d, min({'t': e.up, 'd': CAST(i.d - e.off AS DATE)}) AS up
  FROM inst i JOIN deps e ON e.t = i.t LEFT JOIN inst u ON u.t = e.up AND u.d = i.d - e.off
  WHERE NOT i.ok AND NOT coalesce(u.ok, false) GROUP BY i.t, i.d),
walk AS (
  SELECT t, d, up AS pos, 1 AS n, [{'t': t, 'd': d}] AS passed FROM blocked
  UNION ALL
  SELECT w.t, w.d, b.up, w.n + 1, list_append(w.passed, w.pos)
  FROM walk w JOIN blocked b ON b.t = w.pos.t AND b.d = w.pos.d WHERE NOT list_contains(w.passed, w.pos)),
ends AS (SELECT t, d, arg_max(pos, n) AS pos, max(n) AS n, arg_max(passed, n) AS passed FROM walk GROUP BY t, d)
SELECT e.t AS task_id, e.d AS biz_date,
  CASE WHEN list_contains(passed, e.pos) THEN 'cycle' WHEN i.t IS NULL THEN 'missing' ELSE 'failed' END AS cause,
  CASE WHEN list_contains(passed, e.pos) THEN list_min(passed[list_position(passed, e.pos):]).t ELSE e.pos.t END AS cause_task,
  CASE WHEN list_contains(passed, e.pos) THEN list_min(passed[list_position(passed, e.pos):]).d ELSE e.pos.d END AS cause_date,
  CASE WHEN NOT list_contains(passed, e.pos) THEN e.n END AS depth
FROM ends e LEFT JOIN inst i ON i.t = e.pos.t AND i.d = e.pos.d"""

ORACLES["audit_paths"] = """
WITH texts AS (
  SELECT event_id AS id,
    CASE WHEN event_id % 15 <> 0 THEN '{"run":{"k":' || user_id || ',"args":["' || event_type || '",' || (event_id % 7)
      || ',{}]},"n":' || (event_id % 5) || ',"x.y":null}' END AS b,
    CASE WHEN event_id % 21 = 0 THEN '{"run": ' ELSE
      '{"n":' || (event_id % 5) || '.0,"x.y":' || CASE WHEN event_id % 6 = 0 THEN 'true' ELSE 'null' END
      || ',"run":{"args":["' || event_type || '",'
      || CASE event_id % 3 WHEN 0 THEN (event_id % 7 + 1)::VARCHAR WHEN 1 THEN (event_id % 7) || 'e0' ELSE (event_id % 7)::VARCHAR END
      || CASE WHEN event_id % 11 = 0 THEN ']' ELSE ',{}]' END || ',"k":' || user_id || '}}' END AS a
  FROM events),
good AS (SELECT * FROM texts WHERE json_valid(a)),
sides AS (SELECT id AS rid, TRUE AS old, b AS j FROM good WHERE b IS NOT NULL UNION ALL SELECT id, FALSE, a FROM good),
nodes AS (SELECT s.rid, s.old, t.fullkey AS path, t.type AS kind, t.value AS v FROM sides s, json_tree(s.j) t),
leaves AS (
  SELECT rid, old, path,
    CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN kind = 'VARCHAR' THEN 'string' ELSE lower(coalesce(kind, 'null')) END AS type,
    CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(CAST(CAST(v AS DOUBLE) AS BIGINT) AS VARCHAR)
         WHEN kind = 'VARCHAR' THEN v ->> '$' WHEN coalesce(kind, 'NULL') = 'NULL' THEN 'null' ELSE CAST(v AS VARCHAR) END AS value
  FROM nodes WHERE coalesce(kind, 'NULL') NOT IN ('OBJECT', 'ARRAY') OR CAST(v AS VARCHAR) IN ('{}', '[]')),
both_sides AS (
  SELECT rid AS id, path, max(CASE WHEN old THEN type END) AS old_type, max(CASE WHEN old THEN value END) AS before,
    max(CASE WHEN NOT old THEN type END) AS new_type, max(CASE WHEN NOT old THEN value END) AS after
  FROM leaves GROUP BY 1, 2),
judged AS (
  SELECT id, path, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed'
      WHEN old_type <> new_type OR before <> after THEN 'changed' END AS change, old_type, before, new_type, after
  FROM both_sides)
SELECT * FROM judged WHERE change IS NOT NULL
UNION ALL SELECT id, NULL, 'malformed', NULL, b, NULL, a FROM texts WHERE NOT json_valid(a)"""

# The bucket that holds the exact value of the rank, by its middle: error 0.01.
_MIDDLE = """CASE WHEN {0} < 1 THEN 0 ELSE round(pow(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE),
    ceil(ln({0}) / ln(CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE)))) * (2 / (CAST(1.01 AS DOUBLE) / CAST(0.99 AS DOUBLE) + 1)), 3) END"""

ORACLES["range_percentiles"] = with_(RUNS) + """,
own AS (
  SELECT tenant_id, count(*) AS n, list_sort(list(CAST(duration_s AS DOUBLE))) AS x
  FROM runs WHERE CAST(started_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' AND duration_s IS NOT NULL GROUP BY 1),
exact AS (
  SELECT tenant_id, n, x[CAST(ceil(CAST(0.5 AS DOUBLE) * n) AS BIGINT)] AS a, x[CAST(ceil(CAST(0.95 AS DOUBLE) * n) AS BIGINT)] AS b,
    x[CAST(ceil(CAST(0.99 AS DOUBLE) * n) AS BIGINT)] AS c
  FROM own)
SELECT tenant_id, n, """ + ", ".join(f"{_MIDDLE.format(v)} AS {name}" for v, name in (("a", "p50_s"), ("b", "p95_s"), ("c", "p99_s"))) + """
FROM exact"""

ORACLES["range_instances"] = with_(INSTANCE_EVENTS) + """
SELECT tenant_id, count(DISTINCT instance_id) AS n_distinct FROM instance_events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' GROUP BY 1"""

ORACLES["next_day_instances"] = with_(INSTANCE_EVENTS) + """,
seen AS (SELECT DISTINCT CAST(ts AS DATE) AS day, tenant_id, instance_id FROM instance_events),
counts AS (SELECT day, tenant_id, count(*) AS n FROM seen GROUP BY 1, 2),
twice AS (
  SELECT x.day, x.tenant_id, count(*) AS n FROM seen x
  JOIN seen y ON y.instance_id = x.instance_id AND y.tenant_id = x.tenant_id AND y.day = x.day + 1 GROUP BY 1, 2)
SELECT a.day, a.tenant_id, a.n AS n_day, coalesce(t.n, 0) AS n_both, a.n + b.n - coalesce(t.n, 0) AS n_either
FROM counts a JOIN counts b ON b.day = a.day + 1 AND b.tenant_id = a.tenant_id
LEFT JOIN twice t ON t.day = a.day AND t.tenant_id = a.tenant_id"""

ORACLES["month_retention"] = with_(RUNS) + """
SELECT o_orderkey AS version_id, o_orderdate, strftime(o_orderdate, '%Y%m') AS m FROM orders
WHERE NOT coalesce(o_orderdate < TIMESTAMP '2001-01-15 12:00:00' - INTERVAL 365 DAY, false)
  OR o_orderkey IN (SELECT event_id FROM runs WHERE ended_at IS NULL)"""

ORACLES["version_diff"] = """
WITH new_orders AS (
  SELECT CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 100000000 ELSE o_orderkey END AS k,
    CASE WHEN o_orderkey % 101 <> 7 THEN o_orderstatus END AS s,
    CASE WHEN o_orderkey % 89 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS p
  FROM orders),
both_sides AS (
  SELECT coalesce(o_orderkey, k) AS o_orderkey, o_orderkey IS NOT NULL AS had, k IS NOT NULL AS has,
    o_orderstatus IS DISTINCT FROM s AS ds, o_totalprice IS DISTINCT FROM p AS dp
  FROM orders FULL JOIN new_orders ON k = o_orderkey)
SELECT o_orderkey, CASE WHEN NOT had THEN 'only_new' WHEN NOT has THEN 'only_old' ELSE 'changed' END AS status,
  CASE WHEN NOT (had AND has) THEN '' WHEN ds AND dp THEN 'o_orderstatus,o_totalprice' WHEN ds THEN 'o_orderstatus' ELSE 'o_totalprice' END AS changed_cols,
  CAST(had AS BIGINT) AS n_old, CAST(has AS BIGINT) AS n_new
FROM both_sides WHERE NOT (had AND has) OR ds OR dp"""
