"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads whole test tables (or tables Spark derives from them); none
filters rows by id, modulo or prefix to stay cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchwright.plans import company_dim as _company_dim

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}

# The load stamp of the checked query; jobs stamp the time they run at.
LOAD_STAMP = "2026-06-13 00:00:00"


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


@register("company_dim")
def q_company_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _company_dim.company_dim(spark, sf_dir, as_of=LOAD_STAMP)


# ---------------------------------------------------------------- dedup, flags
from pyspark.sql import functions as F  # noqa: E402

from batchwright.functions import bizdate as BD  # noqa: E402
from batchwright.functions import templates as TM  # noqa: E402
from batchwright.functions.columns import change_flag  # noqa: E402
from batchwright.operators.asof import as_of_join, lock_versions, publish_history  # noqa: E402
from batchwright.plans import standins as S  # noqa: E402
from batchwright.sources.tables import load  # noqa: E402


@register("dedup_latest")
def q_dedup_latest(spark, sf_dir):
    return _company_dim.dedup_mapping(S.company_mapping(load(spark, sf_dir, "lineitem")))


@register("change_flag")
def q_change_flag(spark, sf_dir):
    base = S.company_base(load(spark, sf_dir, "orders"))
    return base.select("company_id", change_flag("is_del", "insert_time", "update_time").alias("isadd"))


# ---------------------------------------------------------------- business dates
@register("biz_date_cols")
def q_biz_date_cols(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    hr_text = F.when(F.col("event_id") % 17 == 0, F.lit("24")).otherwise(F.date_format("ts", "HH"))
    return ev.select("event_id", *BD.biz_cols(F.to_date("ts"), lags=(1, 7, 365),
                                              date_lags=(1, 30), hour=hr_text))


DATED_SQL = """
SELECT event_type, '${{dt}}' AS biz_dt, '${{dt-1}}' AS prev_dt, '${{date}}' AS biz_date,
  '${{hr}}' AS biz_hr, count(*) AS n_events,
  count(CASE WHEN date_format(ts, 'yyyyMMdd') = '${{dt}}' THEN 1 END) AS n_on_day,
  count(CASE WHEN date_format(ts, 'yyyyMMdd') = '${{dt-1}}' THEN 1 END) AS n_prev_day
FROM {view} GROUP BY event_type
"""


@register("dated_query")
def q_dated_query(spark, sf_dir):
    import uuid
    view = f"events_{uuid.uuid4().hex[:12]}"
    load(spark, sf_dir, "events").createOrReplaceTempView(view)
    try:  # the plan keeps what the view stands for
        return BD.run_query(spark, DATED_SQL.format(view=view), "20240115", "03")
    finally:
        spark.catalog.dropTempView(view)


def _backfills(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    start = F.date_add(F.lit("2026-06-01").cast("date"), (F.col("c_custkey") % 5).cast("int"))
    # some ranges end the day before they start
    end = F.date_add(start, (F.col("c_nationkey") % 7 - 1).cast("int"))
    version = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("v"), F.col("c_custkey").cast("string")))
    return c.select(F.col("c_custkey").cast("string").alias("task_id"),
                    start.alias("s"), end.alias("e"), version.alias("v"))


@register("backfill_dates")
def q_backfill_dates(spark, sf_dir):
    df = _backfills(spark, sf_dir)
    return BD.backfill(df, F.col("s"), F.col("e"), F.col("v")).select("task_id", "biz_date", "version_choice")


# ---------------------------------------------------------------- as-of lookups
@register("variable_as_of")
def q_variable_as_of(spark, sf_dir):
    lookups = S.variable_lookups(load(spark, sf_dir, "events"))
    variables = S.project_variables(load(spark, sf_dir, "orders"))
    return as_of_join(lookups, variables, keys=["project_id", "name"], left_ts="at",
                      right_ts="effective_at", right_cols=["value", "version"], tie="seq")


def _attempts(events):
    return events.select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("instance_id"),
        F.col("user_id").cast("string").alias("task_id"),
        (F.col("ts") - F.expr("INTERVAL 26 YEARS")).alias("created_at"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("explicit_version"))


@register("version_lock")
def q_version_lock(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return lock_versions(_attempts(load(spark, sf_dir, "events")),
                         publish_history(S.task_versions(orders), S.rollbacks(orders)))


# ---------------------------------------------------------------- templates
def _scripts(spark, sf_dir):
    return S.scripts(load(spark, sf_dir, "events"))


@register("placeholder_scan")
def q_placeholder_scan(spark, sf_dir):
    sc = _scripts(spark, sf_dir)
    ph = TM.placeholders("text")
    return sc.select("script_id", F.array_join(ph, " ").alias("placeholders"),
                     F.size(ph).cast("bigint").alias("n_placeholders"))


@register("pattern_match")
def q_pattern_match(spark, sf_dir):
    return (TM.scan(_scripts(spark, sf_dir), "script_id", "text")
            .select("script_id", F.col("pos").cast("bigint").alias("pos"), "placeholder", "variable"))


@register("render_templates")
def q_render_templates(spark, sf_dir):
    sc = _scripts(spark, sf_dir)
    r = TM.render("text", "biz_date", "biz_hour")
    return (sc.select("script_id", r.alias("r"))
              .select("script_id", F.col("r.text").alias("rendered"),
                      TM.failures(F.col("r.unresolved")).alias("unresolved"),
                      F.col("r.error").alias("error")))


@register("bake_templates")
def q_bake_templates(spark, sf_dir):
    sc = _scripts(spark, sf_dir).select("script_id", "project_id", "at", "text")
    variables = S.project_variables(load(spark, sf_dir, "orders"))
    return TM.bake(sc, variables).select("script_id", "baked", "var_versions", "unresolved")


@register("preview_templates")
def q_preview_templates(spark, sf_dir):
    variables = S.project_variables(load(spark, sf_dir, "orders"))
    return TM.preview(_scripts(spark, sf_dir), variables)


@register("unresolved_vars")
def q_unresolved_vars(spark, sf_dir):
    return TM.unresolved(_scripts(spark, sf_dir), S.project_variables(load(spark, sf_dir, "orders")))


# ---------------------------------------------------------------- policy, logs
from batchwright.functions import logs as LG  # noqa: E402
from batchwright.operators.policy import policy_check, task_policy  # noqa: E402
from batchwright.operators.rules import match_by_catalog, policy_by_rules  # noqa: E402


@register("policy_check")
def q_policy_check(spark, sf_dir):
    return policy_check(S.conf_rows(load(spark, sf_dir, "part")))


@register("task_policy")
def q_task_policy(spark, sf_dir):
    return task_policy(S.conf_rows(load(spark, sf_dir, "part")))


def policy_rules(part):
    """Rules from parts, per tenant (p_size mod 10): the part's brand and container
    as a prefix of names to allow, its whole name to deny, and deny prefixes."""
    tenant = (F.col("p_size") % 10).cast("string").alias("tenant_id")
    word = F.split("p_name", " ")
    one = lambda effect, match, pattern, where: part.where(where).select(
        tenant, F.lit(effect).alias("effect"), F.lit(match).alias("match"), pattern.alias("pattern"))
    return (one("allow", "prefix", F.substring("p_name", 1, 4), F.col("p_size") % 3 != 0)
            .unionByName(one("allow", "key", F.col("p_name"), F.col("p_size") % 3 == 0))
            .unionByName(one("deny", "prefix", F.concat(F.get(word, F.lit(0)), F.lit(" ")), F.col("p_size") % 7 == 0))
            .unionByName(one("deny", "key", F.col("p_name"), F.col("p_size") % 11 == 0)))


@register("policy_rules")
def q_policy_rules(spark, sf_dir):
    """Every part's name as a key, under the rules of the tenant its key names."""
    part = load(spark, sf_dir, "part")
    conf = part.select("p_partkey", (F.col("p_partkey") % 10).cast("string").alias("tenant_id"), F.col("p_name").alias("key"))
    return policy_by_rules(conf, policy_rules(part), by=["tenant_id"])


@register("catalog_match")
def q_catalog_match(spark, sf_dir):
    """Placeholders of all scripts against a catalog that is a table: the fixed
    variables first, then one pattern per event type and one per project variable."""
    names = S.scripts(load(spark, sf_dir, "events")).select(
        "script_id", "at", F.explode(TM.placeholders("text")).alias("placeholder"))
    fixed = spark.createDataFrame([(i, n, p) for i, (n, p, _) in enumerate(TM.CATALOG)], "position int, variable string, pattern string")
    kinds = load(spark, sf_dir, "events").select("event_type").distinct().select(
        F.lit(100).alias("position"), F.concat(F.lit("unknown-"), "event_type").alias("variable"),
        F.concat(F.lit(r"^\$\{unknown_"), "event_type", F.lit(r"\}$")).alias("pattern"))
    other = spark.createDataFrame([(200, "project", r"^\$\{prj\.p[0-9]\}$"), (300, "bad offset", r"^\$\{(dt|date)-0[0-9]+\}$")],
                                  "position int, variable string, pattern string")
    return match_by_catalog(names, fixed.unionByName(kinds).unionByName(other))


@register("log_parse")
def q_log_parse(spark, sf_dir):
    lines = S.log_lines(load(spark, sf_dir, "events")).select("event_id", "line")
    return LG.parse_log(lines).drop("line")


@register("first_app_id")
def q_first_app_id(spark, sf_dir):
    return LG.first_match(S.log_lines(load(spark, sf_dir, "events")), "instance_id", ["ts", "event_id"])


@register("redact_paths")
def q_redact_paths(spark, sf_dir):
    lines = S.log_lines(load(spark, sf_dir, "events"))
    return lines.select("event_id", LG.redact("line").alias("line"))


# ---------------------------------------------------------------- sinks
from batchwright.session import scratch_path  # noqa: E402
from batchwright.sources import snapshots as SN  # noqa: E402
from batchwright.sources import writers as W  # noqa: E402


@register("content_digest")
def q_content_digest(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return SN.content_digest(docs).select("doc_id", "sha256", "byte_size")


def _write_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    root = scratch_path(spark, "snapshots")
    SN.write_version(docs, root, "prod", "documents", "v1",
                     meta={"draft_revision_id": "r1", "baked_by": "batch",
                           "baked_at": "2026-06-13T00:00:00", "project_var_versions": {"prj.p1": 3}},
                     text_col="text")
    return root


@register("snapshot_roundtrip")
def q_snapshot_roundtrip(spark, sf_dir):
    root = _write_documents(spark, sf_dir)
    back = SN.read_version(spark, root, "prod", "documents", "v1")
    return SN.content_digest(back).select("doc_id", "lang", "sha256", "byte_size")


@register("manifest_read")
def q_manifest_read(spark, sf_dir):
    root = _write_documents(spark, sf_dir)
    m = SN.read_manifest(spark, root, "prod", "documents", "v1")
    return m.select("env", "task_id", "version_id", "draft_revision_id", "baked_by", "n_rows",
                    "byte_size", "status",
                    F.col("project_var_versions")["prj.p1"].alias("prj_p1_version"))


@register("valid_segments")
def q_valid_segments(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    seg = F.regexp_extract("url", "[^/]*$", 0)
    return pages.select("page_id", seg.alias("segment"), SN.valid_segment(seg).alias("ok"))


@register("table_overwrite")
def q_table_overwrite(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    path = scratch_path(spark, "table_overwrite")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    W.overwrite_table(orders, path, cols)
    second = orders.select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"),
                           F.upper("o_orderpriority").alias("o_orderpriority"))
    W.overwrite_table(second, path, cols)
    return spark.read.parquet(path)


def _events_dt_hr(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ev.select("event_id", "event_type", "value",
                     F.date_format("ts", "yyyyMMdd").alias("dt"), F.date_format("ts", "HH").alias("hr"))


@register("partition_overwrite")
def q_partition_overwrite(spark, sf_dir):
    ev = _events_dt_hr(spark, sf_dir)
    path = scratch_path(spark, "partition_overwrite")
    W.overwrite_table(ev, path, partition_cols=["dt", "hr"])
    slot = BD.for_date(W.read_table(spark, path), "20240115").filter(F.col("hr") == "03")
    replacement = slot.select("event_id", F.upper("event_type").alias("event_type"),
                              (F.col("value") * 2).alias("value"))
    W.overwrite_partition(replacement, path, {"dt": "20240115", "hr": "03"})
    return W.read_table(spark, path, partition_cols=["dt", "hr"])


@register("partition_overwrite_empty")
def q_partition_overwrite_empty(spark, sf_dir):
    """A4: an hour whose reload is empty holds nothing afterwards."""
    path = scratch_path(spark, "partition_overwrite_empty")
    W.overwrite_table(_events_dt_hr(spark, sf_dir), path, partition_cols=["dt", "hr"])
    none = W.read_table(spark, path).where("dt = '20240115' and hr = '03' and value < 0")
    W.overwrite_partition(none.select("event_id", "event_type", "value"), path, {"dt": "20240115", "hr": "03"})
    return W.read_table(spark, path, partition_cols=["dt", "hr"])


@register("pruned_day")
def q_pruned_day(spark, sf_dir):
    """B10 on a partitioned table: one business date reads one day's folders."""
    path = scratch_path(spark, "pruned_day")
    W.overwrite_table(_events_dt_hr(spark, sf_dir).drop("hr"), path, partition_cols=["dt"])
    day = BD.for_date(W.read_table(spark, path, partition_cols=["dt"]), "20240115")
    return day.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


@register("partition_append")
def q_partition_append(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    staging = ev.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyyMMdd").alias("dt"),
                        F.date_format("ts", "yyyy-MM-dd").alias("biz"), F.date_format("ts", "yyyyMM").alias("m"))
    path = scratch_path(spark, "partition_append")
    W.append_partition(staging, path, {}, ["dt", "m"])
    day = BD.for_date(staging, "20240115").select("id", "biz")
    W.append_partition(day, path, {"dt": "20240115", "m": "202401"})
    t = W.read_table(spark, path, partition_cols=["dt", "m"])
    return t.groupBy("dt", "m").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.countDistinct("id").alias("n_ids"))


@register("rows_append")
def q_rows_append(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH").alias("hr"))
    path = scratch_path(spark, "rows_append")
    W.append_rows(ev, path, ["hr"])
    literal = spark.createDataFrame([(-1, "03")], "event_id long, hr string")
    W.append_rows(literal, path, ["hr"])
    return W.read_table(spark, path, partition_cols=["hr"])


@register("month_archive")
def q_month_archive(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    path = scratch_path(spark, "month_archive")
    W.archive_by_month(orders, "o_orderdate", path)
    t = W.read_table(spark, path, partition_cols=["m"])
    return t.groupBy("m").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(W.is_expired("o_orderdate", 365, "2001-01-01 00:00:00"), 1)).alias("n_expired"))


@register("month_retention")
def q_month_retention(spark, sf_dir):
    """What is left of an archive of versions after a year's retention: running instances keep theirs."""
    path = scratch_path(spark, "month_retention")
    W.archive_by_month(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), "o_orderdate"), "o_orderdate", path)
    running = _runs(spark, sf_dir).where(F.col("ended_at").isNull()).select(F.col("event_id").alias("version_id"))
    W.drop_expired(spark, path, "o_orderdate", 365, "2001-01-15 12:00:00", keep=running, keys=["version_id"])
    return W.read_table(spark, path, partition_cols=["m"])


# ---------------------------------------------------------------- task metadata audits
from batchwright.operators import lifecycle as LC  # noqa: E402
from batchwright.operators import rollups as RU  # noqa: E402
from batchwright.operators.audit import audit_paths  # noqa: E402
from batchwright.operators.dedup import current_state, dedupe_triggers, first_result  # noqa: E402
from batchwright.operators.overlap import concurrency_by_minute, running_between  # noqa: E402
from batchwright.operators.replay import replay, true_states  # noqa: E402
from batchwright.operators.waiting import waiting_causes  # noqa: E402
from batchwright.sources import hashtree as HT  # noqa: E402


def _ievents(spark, sf_dir):
    return S.instance_events(load(spark, sf_dir, "events"))


def _runs(spark, sf_dir):
    return S.runs(load(spark, sf_dir, "events"))


@register("transition_audit")
def q_transition_audit(spark, sf_dir):
    return LC.transition_counts(_ievents(spark, sf_dir))


@register("current_state")
def q_current_state(spark, sf_dir):
    return current_state(_ievents(spark, sf_dir))


@register("state_replay")
def q_state_replay(spark, sf_dir):
    """Every event's verdict against the instance's true state."""
    return replay(_ievents(spark, sf_dir), LC.LEGAL_EDGES).select(
        "event_id", "instance_id", "from_state", "state", "legal", "true_state")


@register("true_state")
def q_true_state(spark, sf_dir):
    return true_states(replay(_ievents(spark, sf_dir), LC.LEGAL_EDGES))


@register("published_pointer")
def q_published_pointer(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return LC.published_pointer(S.task_versions(orders), S.rollbacks(orders))


@register("peak_running")
def q_peak_running(spark, sf_dir):
    return LC.peak_running(_runs(spark, sf_dir))


@register("running_between")
def q_running_between(spark, sf_dir):
    """Runs that overlap the first half hour after an order of their tenant, 26 years later."""
    ranges = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("range_id"), (F.col("o_custkey") % 10).cast("string").alias("tenant_id"),
        F.timestamp_add("YEAR", F.lit(26), F.col("o_orderdate")).cast("timestamp_ntz").alias("from_at"))
    ranges = ranges.withColumn("to_at", F.timestamp_add("MINUTE", F.lit(30), F.col("from_at")).cast("timestamp_ntz"))
    runs = _runs(spark, sf_dir).select("event_id", "tenant_id", "started_at", "ended_at")
    return running_between(runs, ranges, by=["tenant_id"], as_of="2024-02-01 00:00:00").select(
        "event_id", "range_id", "tenant_id")


@register("concurrency_by_minute")
def q_concurrency_by_minute(spark, sf_dir):
    return concurrency_by_minute(_runs(spark, sf_dir))


@register("sla_breaches")
def q_sla_breaches(spark, sf_dir):
    return (LC.sla_breaches(_runs(spark, sf_dir), 1800, "2024-02-01 00:00:00")
            .select("event_id", "instance_id", "run_s", "still_running"))


@register("trigger_dedupe")
def q_trigger_dedupe(spark, sf_dir):
    t = S.triggers(load(spark, sf_dir, "events"))
    return dedupe_triggers(t).select("instance_id", "task_id", "biz_date", "trigger_source",
                                     "first_instance_id", "is_duplicate")


@register("instance_filter")
def q_instance_filter(spark, sf_dir):
    t = S.triggers(load(spark, sf_dir, "events"))
    return (LC.instances(t, source="backfill", tenants=["1", "2"],
                         between=("2024-01-05 00:00:00", "2024-01-20 00:00:00"))
            .select("instance_id", "task_id", "tenant_id", "created_at"))


@register("instance_by_app_id")
def q_instance_by_app_id(spark, sf_dir):
    t = S.triggers(load(spark, sf_dir, "events"))
    return (LC.instances(t.withColumn("application_id", F.concat(F.lit("application_"), F.col("tenant_id"))),
                         app_id="application_3").select("instance_id", "task_id", "application_id"))


def _day_instances(spark, sf_dir):
    """One row per attempt; a task has many attempts on a day."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.to_date("ts").alias("biz_date"),
        F.when(F.col("event_type") != "view", F.col("event_type") == "purchase").alias("ok"))


@register("dependency_ready")
def q_dependency_ready(spark, sf_dir):
    inst = _day_instances(spark, sf_dir)
    tasks = load(spark, sf_dir, "events").select(F.col("user_id").alias("task_id")).distinct()
    deps = (tasks.select("task_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("_k"))
                 .select("task_id", (F.col("task_id") - F.col("_k")).alias("upstream_id"),
                         (F.col("task_id") % 3).cast("int").alias("offset"))
                 .filter(F.col("upstream_id") >= 0))
    return LC.ready(inst, deps)


@register("waiting_causes")
def q_waiting_causes(spark, sf_dir):
    """Twenty tasks a day, each after its neighbour and after itself the day
    before; two pairs depend on each other; purchases above 45 are successes."""
    inst = load(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("task_id"), F.to_date("ts").alias("biz_date"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 45)).alias("ok"))
    t = inst.select("task_id").distinct()
    dep = lambda where, up, offset: t.where(where).select(
        "task_id", up.cast("long").alias("upstream_id"), F.lit(offset).alias("offset"))
    task = F.col("task_id")
    deps = (dep(task % 5 != 0, task - 1, 0).unionByName(dep(task % 5 == 0, task, 1)).unionByName(dep(task % 10 == 3, task + 1, 0))
            .unionByName(dep(task % 10 == 4, task - 1, 0)).unionByName(dep(task == 19, task + 1, 0)))
    return waiting_causes(inst, deps)


@register("registry_reconcile")
def q_registry_reconcile(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.nullif(F.col("c_custkey"), F.lit(7)).alias("key"))
    b = load(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None))
         .when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 100000)
         .otherwise(F.col("o_custkey")).alias("key"))
    return LC.reconcile(a, b, ["key"])


@register("run_compare")
def q_run_compare(spark, sf_dir):
    """Two runs of one job over lineitem: the order is the key, missing for
    returned lines and repeated for the others; the second run changed some."""
    li = load(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))
    a = li.select(key.alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                  F.nullif(F.col("l_linestatus"), F.lit("O")).alias("mode"))
    b = a.select(F.when(F.col("k") % 13 == 0, F.col("k") + 1000000).otherwise(F.col("k")).alias("k"), "line",
                 F.when(F.col("k") % 10 == 0, F.col("part") + 1).otherwise(F.col("part")).alias("part"),
                 F.when(F.col("k") % 15 == 0, F.lit(None)).otherwise(F.col("mode")).alias("mode"))
    return LC.compare_runs(a, b, ["k", "line"], ["part", "mode"])


@register("run_compare_repeated")
def q_run_compare_repeated(spark, sf_dir):
    """The same with the order alone as key: most keys repeat on both sides."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part"))
    b = li.select(F.when(F.col("part") % 50 == 0, F.lit(None)).otherwise(F.col("k")).alias("k"), "part")
    return LC.compare_runs(li, b, ["k"], ["part"])


@register("version_diff")
def q_version_diff(spark, sf_dir):
    """Two stored versions of all orders, compared by their trees: some prices
    and states changed, some keys moved."""
    o, key = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    new = o.select(F.when(key % 97 == 5, key + 100000000).otherwise(key).alias("o_orderkey"),
                   F.when(key % 101 != 7, F.col("o_orderstatus")).alias("o_orderstatus"),
                   F.when(key % 89 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    paths = [scratch_path(spark, f"version_{n}") for n in ("old", "new")]
    for df, path in zip((o, new), paths):
        HT.write_tree(df, path, ["o_orderkey"])
    return HT.compare_versions(spark, *paths, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@register("lineage_walk")
def q_lineage_walk(spark, sf_dir):
    inst = load(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("version_id"))
    orders = load(spark, sf_dir, "orders")
    versions = orders.select(F.col("o_orderkey").alias("version_id"),
                             F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("draft_revision_id"))
    tasks = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"),
                                                   F.col("c_nationkey").alias("project_id"))
    projects = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"),
                                                    F.col("n_name").alias("project_name"))
    return LC.lineage(inst, versions, S.drafts(orders), tasks, projects).select(
        "event_id", "version_id", "draft_revision_id", "author", "task_id", "project_id", "project_name")


@register("trace_rows")
def q_trace_rows(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    logs = S.log_lines(ev).select(F.concat(F.lit("trace-"), F.col("instance_id")).alias("trace_id"), "ts",
                                  F.lit("driver").alias("layer"), F.col("line").alias("detail"))
    inst = S.instance_events(ev).select("trace_id", "ts", F.lit("instance").alias("layer"),
                                        F.col("state").alias("detail"))
    runs = (S.runs(ev).filter(F.col("ended_at").isNotNull())
            .select("trace_id", F.col("ended_at").alias("ts"), F.lit("run").alias("layer"),
                    F.concat(F.lit("ended "), F.col("state")).alias("detail")))
    return LC.trace([logs, inst, runs])


@register("run_metrics")
def q_run_metrics(spark, sf_dir):
    return LC.run_metrics(_runs(spark, sf_dir))


@register("retry_stats")
def q_retry_stats(spark, sf_dir):
    return LC.retry_stats(_ievents(spark, sf_dir))


@register("retry_success")
def q_retry_success(spark, sf_dir):
    return LC.retry_summary(LC.retry_stats(_ievents(spark, sf_dir)))


@register("trace_coverage")
def q_trace_coverage(spark, sf_dir):
    parsed = LG.parse_log(S.log_lines(load(spark, sf_dir, "events")).select("line"))
    return LC.instance_coverage(parsed.select("task_id", "instance_id", "trace_id"), by="task_id")


@register("application_coverage")
def q_application_coverage(spark, sf_dir):
    parsed = LG.parse_log(S.log_lines(load(spark, sf_dir, "events")).select("line"))
    return LC.coverage(parsed, "application_id", by="task_id")


@register("adapter_metrics")
def q_adapter_metrics(spark, sf_dir):
    return LC.adapter_metrics(S.adapter_calls(load(spark, sf_dir, "events")))


@register("daily_counts")
def q_daily_counts(spark, sf_dir):
    return LC.daily_counts(_ievents(spark, sf_dir))


def _stored(spark, rollup, name):
    """The daily rows written once; ranges read these instead of the runs."""
    path = scratch_path(spark, name)
    W.overwrite_table(rollup, path)
    return W.read_table(spark, path)


@register("range_percentiles")
def q_range_percentiles(spark, sf_dir):
    """Run times of 20 days per tenant, merged from one stored row a day."""
    runs = _runs(spark, sf_dir).withColumn("day", F.to_date("started_at"))
    stored = _stored(spark, RU.value_rollup(runs, ["tenant_id"], "day", "duration_s"), "value_rollup")
    return RU.merged_percentiles(RU.between_days(stored, "2024-01-05", "2024-01-24"), ["tenant_id"],
                                 [0.5, 0.95, 0.99], ["p50_s", "p95_s", "p99_s"])


def _set_rollup(spark, sf_dir):
    ev = _ievents(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return _stored(spark, RU.set_rollup(ev, ["tenant_id"], "day", "instance_id"), "set_rollup")


@register("range_instances")
def q_range_instances(spark, sf_dir):
    """Distinct instances of 20 days per tenant, merged from one stored sketch a day."""
    return RU.merged_distinct(RU.between_days(_set_rollup(spark, sf_dir), "2024-01-05", "2024-01-24"), ["tenant_id"])


@register("next_day_instances")
def q_next_day_instances(spark, sf_dir):
    """Per day and tenant: its instances, those active the next day too, and those of either day."""
    return RU.days_apart(_set_rollup(spark, sf_dir), ["tenant_id"])


@register("first_publish")
def q_first_publish(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("revision"),
        F.col("o_orderpriority").alias("idem_key"), F.col("o_orderkey").alias("result"),
        F.col("o_orderdate").alias("requested_at"))
    return first_result(o, ["task_id", "revision", "idem_key"], "requested_at", "result")


@register("audit_diff")
def q_audit_diff(spark, sf_dir):
    """Keys that change, go, come, turn to null and back; and broken texts."""
    ev = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    t = F.concat(F.lit('"t": "'), F.col("event_type"), F.lit('"}'))
    before = (F.when(F.col("event_id") % 14 == 0, F.lit('{"k": null}'))
               .when(F.col("event_id") % 15 == 0, F.lit(None)).otherwise(F.col("props")))
    after = (F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("{"), t))
              .when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"k": null, '), t))
              .when(F.col("event_id") % 21 == 0, F.lit('{"k": '))
              .when(F.col("event_id") % 4 == 0,
                    F.concat(F.lit('{"k": '), (k.cast("int") + 1).cast("string"), F.lit(", "), t))
              .otherwise(F.concat(F.lit('{"k": '), k, F.lit(", "), t)))
    audit = ev.select(F.col("event_id").alias("id"), before.alias("before_json"), after.alias("after_json"))
    return LC.audit_diff(audit)


@register("audit_paths")
def q_audit_paths(spark, sf_dir):
    """Nested values that change, go and come by path; other key orders and
    number forms, which are no change; missing records and broken texts."""
    eid = F.col("event_id")
    s = lambda c: c.cast("string")
    n, k = s(eid % 5), s(F.col("user_id"))
    before = F.concat(F.lit('{"run":{"k":'), k, F.lit(',"args":["'), F.col("event_type"), F.lit('",'), s(eid % 7),
                      F.lit(',{}]},"n":'), n, F.lit(',"x.y":null}'))
    number = F.when(eid % 3 == 0, s(eid % 7 + 1)).when(eid % 3 == 1, F.concat(s(eid % 7), F.lit("e0"))).otherwise(s(eid % 7))
    after = F.concat(F.lit('{"n":'), n, F.lit('.0,"x.y":'), F.when(eid % 6 == 0, F.lit("true")).otherwise(F.lit("null")),
                     F.lit(',"run":{"args":["'), F.col("event_type"), F.lit('",'), number,
                     F.when(eid % 11 == 0, F.lit("]")).otherwise(F.lit(",{}]")), F.lit(',"k":'), k, F.lit("}}"))
    return audit_paths(load(spark, sf_dir, "events").select(
        eid.alias("id"), F.when(eid % 15 != 0, before).alias("before_json"),
        F.when(eid % 21 == 0, F.lit('{"run": ')).otherwise(after).alias("after_json")))


@register("lint_report")
def q_lint_report(spark, sf_dir):
    unresolved = q_unresolved_vars(spark, sf_dir).select(
        F.lit("script").alias("subject_type"), F.col("script_id").cast("string").alias("subject_id"),
        F.lit("unresolved_variable").alias("rule"), F.col("placeholder").alias("detail"))
    errors = _scripts(spark, sf_dir).select(
        "script_id", TM.render_error("text", "biz_date", "biz_hour").alias("error"))
    rendered = errors.filter(F.col("error").isNotNull()).select(
        F.lit("script").alias("subject_type"), F.col("script_id").cast("string").alias("subject_id"),
        F.lit("render_error").alias("rule"), F.col("error").alias("detail"))
    conf = q_policy_check(spark, sf_dir).filter(F.col("verdict") != "accepted").select(
        F.lit("task").alias("subject_type"), F.col("task_id").alias("subject_id"),
        F.lit("conf_rejected").alias("rule"), F.concat(F.col("key"), F.lit(": "), F.col("verdict")).alias("detail"))
    segs = q_valid_segments(spark, sf_dir).filter(~F.col("ok")).select(
        F.lit("page").alias("subject_type"), F.col("page_id").cast("string").alias("subject_id"),
        F.lit("bad_segment").alias("rule"), F.col("segment").alias("detail"))
    ranges = _backfills(spark, sf_dir).select("task_id", BD.backfill_error("s", "e").alias("error")) \
        .filter(F.col("error").isNotNull()).select(
            F.lit("backfill").alias("subject_type"), F.col("task_id").alias("subject_id"),
            F.lit("bad_range").alias("rule"), F.col("error").alias("detail"))
    return unresolved.unionByName(rendered).unionByName(conf).unionByName(segs).unionByName(ranges)


@register("trigger_latency")
def q_trigger_latency(spark, sf_dir):
    return LC.trigger_latency(S.triggers(load(spark, sf_dir, "events")))


@register("publish_metrics")
def q_publish_metrics(spark, sf_dir):
    return LC.publish_metrics(S.publishes(load(spark, sf_dir, "orders")))


@register("publish_histogram")
def q_publish_histogram(spark, sf_dir):
    pubs = S.publishes(load(spark, sf_dir, "orders"))
    return (LC.duration_histogram(pubs, by="project_id", duration="duration_ms", hi=10000.0, buckets=10)
            .withColumnRenamed("n_runs", "n_publishes"))


@register("run_histogram")
def q_run_histogram(spark, sf_dir):
    return LC.duration_histogram(_runs(spark, sf_dir))


INSERT_PARTITION_SQL = (
    "INSERT OVERWRITE TABLE {table} PARTITION (day='${{dt}}', hour='${{hr}}') "
    "SELECT click_id, concat('reload of ', '${{date}}') FROM {source} WHERE on_day = '${{date}}' AND at_hour = '${{hr}}'")


@register("insert_overwrite_partition")
def q_insert_overwrite_partition(spark, sf_dir):
    """A4 + U2 through SQL text: a catalog table partitioned by (day, hour) is
    loaded from all events, then one static partition is replaced by a rendered
    INSERT OVERWRITE ... PARTITION statement.  Table and view have names of
    their own and are dropped again; the result reads the files."""
    import uuid
    ev = load(spark, sf_dir, "events")
    name = uuid.uuid4().hex[:12]
    table, source = f"clicks_{name}", f"clicks_in_{name}"
    clicks = ev.select(F.col("event_id").alias("click_id"), F.date_format("ts", "yyyy-MM-dd").alias("on_day"),
                       F.date_format("ts", "HH").alias("at_hour"))
    clicks.createOrReplaceTempView(source)
    path = scratch_path(spark, table)
    spark.sql(f"CREATE TABLE {table} (click_id BIGINT, note STRING, day STRING, hour STRING) "
              f"USING parquet PARTITIONED BY (day, hour) LOCATION '{path}'")
    try:
        W.insert_into(clicks.select("click_id", F.lit("first load").alias("note"),
                                    F.replace("on_day", F.lit("-"), F.lit("")).alias("day"),
                                    F.col("at_hour").alias("hour")), table, overwrite=True)
        BD.run_query(spark, INSERT_PARTITION_SQL.format(table=table, source=source), "20240115", "03")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.catalog.dropTempView(source)
    return W.read_table(spark, path, partition_cols=["day", "hour"])
