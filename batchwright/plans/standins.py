"""Stand-in inputs derived from the provided test tables.

The warehouse tables the library is written for (company base table, mapping
table, project variables, task versions, instance events, conf rows, ...) do
not exist in the test data, so each is derived here from a test table with
column expressions only.  Every derivation is a projection of a whole table;
no row is sampled or capped, so the work grows with the input.

The same derivations are written as SQL in ``plans/oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Instance state for each event type of the events table.
EVENT_STATE = {
    "signup": "pending",
    "view": "submitting",
    "click": "running",
    "purchase": "succeeded",
    "error": "failed",
}


def _state_of(event_type: Column) -> Column:
    expr = None
    for et, st in EVENT_STATE.items():
        expr = (F.when(event_type == et, F.lit(st)) if expr is None
                else expr.when(event_type == et, F.lit(st)))
    return expr.otherwise(F.lit(None).cast("string"))


def company_base(orders: DataFrame) -> DataFrame:
    """Company base table (all 27 source columns) from orders."""
    o = orders
    key = F.col("o_orderkey")
    cust = F.col("o_custkey")
    odate = F.col("o_orderdate")
    return o.select(
        key.cast("string").alias("company_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("01"))
         .otherwise(F.col("o_orderstatus")).alias("company_type_code"),
        F.concat(F.lit("company-"), key.cast("string")).alias("company_name"),
        cust.alias("oper_key_no"),
        F.concat(F.lit("oper-"), cust.cast("string")).alias("oper_name"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("regist_capi"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(None).cast("string"))
         .otherwise(F.lit("CNY")).alias("regist_capi_curr_name"),
        cust.alias("rec_capi"),
        F.col("o_orderstatus").alias("company_status_name"),
        odate.alias("start_date"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("timestamp_ntz"))
         .otherwise(odate).alias("end_date"),
        F.concat(F.lit("CC"), key.cast("string")).alias("credit_code"),
        key.alias("no"),
        F.col("o_orderpriority").alias("econ_kind"),
        F.substring("o_orderpriority", 1, 1).alias("econ_kind_code"),
        odate.alias("check_date"),
        (cust % 7).alias("belong_org"),
        (cust % 31).alias("province_code"),
        F.concat(F.lit("province-"), (cust % 31).cast("string")).alias("province_name"),
        odate.alias("term_start"),
        F.lit(None).cast("timestamp_ntz").alias("term_end"),
        F.concat(F.lit("addr "), cust.cast("string")).alias("address"),
        F.col("o_orderpriority").alias("scope"),
        F.concat(F.lit("555-"), key.cast("string")).alias("phone_number"),
        F.date_sub(odate, (key % 3).cast("int")).cast("timestamp_ntz").alias("insert_time"),
        odate.alias("update_time"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1")).otherwise(F.lit("0")).alias("is_del"),
    )


def company_mapping(lineitem: DataFrame) -> DataFrame:
    """Mapping table (v2 id -> dwi id with update/insert times) from lineitem."""
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("v2_company_id"),
        F.when(F.col("l_returnflag") == "R", F.lit(""))
         .otherwise(F.col("l_partkey").cast("string")).alias("dwi_company_id"),
        F.col("l_shipdate").alias("update_time"),
        F.col("l_linenumber").alias("insert_time"),
    )


def project_variables(orders: DataFrame) -> DataFrame:
    """Effective-dated project variables (project_id, name, value, version,
    effective_at, seq) from orders; ``seq`` is the storage order used to break
    ties between equal ``effective_at``."""
    return orders.select(
        F.col("o_custkey").cast("string").alias("project_id"),
        F.concat(F.lit("prj.p"), F.substring("o_orderpriority", 1, 1)).alias("name"),
        F.col("o_orderkey").cast("string").alias("value"),
        F.col("o_orderkey").cast("int").alias("version"),
        F.col("o_orderdate").alias("effective_at"),
        F.col("o_orderkey").alias("seq"),
    )


def variable_lookups(events: DataFrame) -> DataFrame:
    """As-of lookups from events: project = user_id, name by event_id mod 5,
    time = event ts moved back 26 years (into the variables' range)."""
    return events.select(
        F.col("event_id").alias("lookup_id"),
        F.col("user_id").cast("string").alias("project_id"),
        F.concat(F.lit("prj.p"), ((F.col("event_id") % 5) + 1).cast("string")).alias("name"),
        (F.col("ts") - F.expr("INTERVAL 26 YEARS")).cast("timestamp_ntz").alias("at"),
    )


def instance_events(events: DataFrame) -> DataFrame:
    """Instance state events: instance (and trace) = user_id, state by event type.

    Also carries tenant (user_id mod 10) and a duration in whole seconds taken
    from ``value`` (value * 60, rounded), used for runs and SLA checks.
    """
    return events.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("instance_id"),
        F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("trace_id"),
        (F.col("user_id") % 10).cast("string").alias("tenant_id"),
        F.col("ts"),
        _state_of(F.col("event_type")).alias("state"),
        F.col("event_type"),
        F.round(F.col("value") * 60).cast("bigint").alias("duration_s"),
    )


def runs(events: DataFrame) -> DataFrame:
    """Run rows (one per event): started = ts, ended = ts + duration seconds;
    errors still running (ended NULL) when value > 40."""
    ev = instance_events(events)
    ended = F.timestamp_add("SECOND", F.col("duration_s"), F.col("ts"))
    return ev.select(
        "event_id", "instance_id", "tenant_id", "trace_id", "state", "duration_s",
        F.col("ts").alias("started_at"),
        F.when((F.col("state") == "failed") & (F.col("duration_s") > 2400),
               F.lit(None).cast("timestamp_ntz")).otherwise(ended).alias("ended_at"),
    )


def task_versions(orders: DataFrame) -> DataFrame:
    """Task versions from orders: task = o_custkey, version = o_orderkey,
    baked_at = o_orderdate, status F published, O superseded, P baked (never
    published)."""
    return orders.select(
        F.col("o_custkey").cast("string").alias("task_id"),
        F.col("o_orderkey").alias("version_id"),
        F.col("o_orderdate").alias("baked_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("published"))
         .when(F.col("o_orderstatus") == "O", F.lit("superseded"))
         .otherwise(F.lit("baked")).alias("status"),
    )


def rollbacks(orders: DataFrame) -> DataFrame:
    """Rollbacks from orders: the pointer of the task goes back to a version of
    lowest priority 300 days after it was published."""
    return orders.where((F.col("o_orderpriority") == "5-LOW") & F.col("o_orderstatus").isin("F", "O")).select(
        F.col("o_custkey").cast("string").alias("task_id"),
        F.timestamp_add("DAY", F.lit(300), F.col("o_orderdate")).alias("rolled_at"),
        F.col("o_orderkey").alias("version_id"),
        F.col("o_orderkey").alias("rollback_id"),
    )


def drafts(orders: DataFrame) -> DataFrame:
    """Draft revisions from orders (draft_revision_id, task_id, author); an
    urgent order's draft is gone, so its lineage breaks there."""
    return orders.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).alias("draft_revision_id"),
        F.col("o_custkey").alias("task_id"),
        F.concat(F.lit("author-"), (F.col("o_custkey") % 100).cast("string")).alias("author"),
    )


def adapter_calls(events: DataFrame) -> DataFrame:
    """Scheduler-adapter calls, one per event: operation by event type, the
    outcome missing where ``value`` is below 1, a timeout for errors above 45."""
    return events.select(
        F.col("event_id").alias("call_id"),
        F.concat(F.lit("call-"), F.col("event_type")).alias("operation"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 45), F.lit("timeout"))
         .when(F.col("value") >= 1, F.lit("ok")).alias("outcome"),
    )


def publishes(orders: DataFrame) -> DataFrame:
    """Publish requests from orders: one per order; project = o_custkey mod 10,
    requested at o_orderdate, publish time floor(o_totalprice) mod 9000 ms,
    outcome failed for status P, else published."""
    return orders.select(
        F.col("o_orderkey").alias("publish_id"),
        F.col("o_custkey").cast("string").alias("task_id"),
        (F.col("o_custkey") % 10).cast("string").alias("project_id"),
        F.col("o_orderdate").alias("requested_at"),
        (F.floor("o_totalprice") % 9000).alias("duration_ms"),
        F.when(F.col("o_orderstatus") == "P", F.lit("failed")).otherwise(F.lit("published")).alias("outcome"),
    )


def scripts(events: DataFrame) -> DataFrame:
    """SQL templates, one per event: runtime placeholders (``${dt}``, ``${hr}``,
    ``${dt-K}`` with K = event_id mod 40, ``${date-K}``, ``${month}``,
    ``${date}``), one project variable ``${prj.pK}`` and, for some rows, an
    undeclared placeholder in a comment.  Two events share a script id, at
    their own times.  project = user_id, at = ts moved back 26 years,
    biz_date/hour from ts; biz_hour is missing for every 13th id."""
    eid = F.col("event_id")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("SELECT count(*) AS n, '${month}' AS in_month, '${date}' AS on_day, '${prj.p"), s(eid % 5 + 1),
        F.lit("}' AS owner FROM clicks_"), F.col("event_type"),
        F.lit(" WHERE day BETWEEN '${dt-"), s(eid % 40), F.lit("}' AND '${dt}' AND since >= '${date-"), s(eid % 7),
        F.lit("}' AND hour = '${hr}' AND batch <> '${dt}' AND event = "), s(eid),
        F.when(eid % 9 == 0, F.concat(F.lit(" -- ${dt-0"), s(eid % 3), F.lit("}")))
         .when(eid % 11 == 0, F.concat(F.lit(" /* ${unknown_"), F.col("event_type"), F.lit("} */")))
         .otherwise(F.lit("")),
    )
    return events.select(
        F.floor(eid / 2).alias("script_id"),
        s(F.col("user_id")).alias("project_id"),
        (F.col("ts") - F.expr("INTERVAL 26 YEARS")).cast("timestamp_ntz").alias("at"),
        F.date_format("ts", "yyyyMMdd").alias("biz_date"),
        F.when(eid % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.date_format("ts", "HH")).alias("biz_hour"),
        text.alias("text"),
    )


# Conf keys the conf-row stand-in picks from (allow, deny, unknown).
CONF_KEYS = [
    "spark.sql.shuffle.partitions", "spark.shuffle.compress",
    "spark.dynamicAllocation.maxExecutors", "spark.executor.memory",
    "spark.executor.memoryOverhead", "spark.driver.memory",
    "spark.yarn.appMasterEnv.PYSPARK_PYTHON", "spark.executorEnv.TZ",
    "spark.hadoop.hive.exec.dynamic.partition", "spark.hadoop.hive.exec.dynamic.partition.mode",
    "spark.executor.cores", "spark.driver.cores",
    "spark.driver.extraJavaOptions", "spark.executor.extraJavaOptions",
    "spark.driver.extraClassPath", "spark.yarn.keytab", "spark.yarn.principal",
    "spark.yarn.dist.files", "spark.kerberos.principal",
    "spark.security.credentials.hive.enabled",
    "spark.master", "spark.app.name", "spark.executor.instances", "spark.jars",
]


def conf_rows(part: DataFrame) -> DataFrame:
    """Conf rows (task_id, key, value): key by p_partkey mod 24, value p_name."""
    keys = F.array(*[F.lit(k) for k in CONF_KEYS])
    return part.select(
        F.col("p_brand").alias("task_id"),
        F.element_at(keys, (F.col("p_partkey") % len(CONF_KEYS) + 1).cast("int")).alias("key"),
        F.col("p_name").alias("value"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    """Driver log lines, one per event, in the structured ``k=v`` format;
    signup lines carry no application id, error lines a keytab path."""
    u = F.col("user_id").cast("string")
    e = F.col("event_id")
    line = F.concat_ws(
        " ",
        F.lit("[driver] run statement"),
        F.concat(F.lit("trace_id=trace-"), u),
        F.concat(F.lit("instance_id="), u),
        F.concat(F.lit("version_id=v"), (e % 7).cast("string")),
        F.concat(F.lit("task_id=task-"), (F.col("user_id") % 10).cast("string")),
        F.concat(F.lit("biz_date="), F.date_format("ts", "yyyyMMdd")),
        F.concat(F.lit("biz_hour="), F.date_format("ts", "HH")),
        F.lit("timezone=Asia/Shanghai"),
        F.when(F.col("event_type") != "signup",
               F.concat(F.lit("application_id=application_"), e.cast("string"), F.lit("_"), u)),
        F.concat(F.lit("stmt="), (e % 5 + 1).cast("string"), F.lit("/5")),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("--keytab /etc/security/keytabs/u"), u, F.lit(".keytab"))),
    )
    return events.select("event_id", "ts", u.alias("instance_id"), line.alias("line"))


def triggers(events: DataFrame) -> DataFrame:
    """Trigger/instance rows: task by user_id mod 20, source backfill for
    signups else schedule, scheduled at the hour of ts (a manual trigger, the
    backfill, has no scheduled time), one instance per event."""
    u = F.col("user_id")
    return events.select(
        F.col("event_id").alias("instance_id"),
        F.concat(F.lit("task-"), (u % 20).cast("string")).alias("task_id"),
        F.date_format("ts", "yyyyMMdd").alias("biz_date"),
        F.when(F.col("event_type") == "signup", F.lit("backfill")).otherwise(F.lit("schedule")).alias("trigger_source"),
        F.when(F.col("event_type") != "signup", F.date_trunc("HOUR", F.col("ts"))).alias("scheduled_at"),
        F.col("ts").alias("created_at"),
        (u % 10).cast("string").alias("tenant_id"),
        F.concat(F.lit("application_"), F.col("event_id").cast("string"), F.lit("_"), u.cast("string")).alias("application_id"),
    )
