"""Unit checks of operator semantics on small hand-made frames."""

from pyspark.sql import functions as F

from batchwright.functions.logs import first_match, parse_log, redact
from batchwright.operators import lifecycle as LC
from batchwright.operators.policy import policy_check, task_policy
from batchwright.plans.company_dim import OUTPUT_COLUMNS, build


def test_deny_wins_over_allow(spark):
    conf = spark.createDataFrame([("t", "spark.sql.x"), ("t", "spark.sql.secret"), ("t", "spark.master")],
                                 "task_id string, key string")
    out = {r["key"]: r["verdict"] for r in policy_check(
        conf, deny_keys=["spark.sql.secret"], deny_prefixes=[], allow_keys=[],
        allow_prefixes=["spark.sql."]).collect()}
    assert out == {"spark.sql.x": "accepted", "spark.sql.secret": "blacklisted",
                   "spark.master": "not in whitelist"}
    t = task_policy(conf).first()
    assert t["accepted"] is False and "spark.master: not in whitelist" in t["rejected"]


def test_default_lists(spark):
    conf = spark.createDataFrame([("spark.yarn.keytab",), ("spark.kerberos.x",), ("spark.executor.memoryOverhead",),
                                  ("spark.driver.cores",), ("spark.jars",)], "key string")
    got = [r["verdict"] for r in policy_check(conf).collect()]
    assert got == ["blacklisted", "blacklisted", "accepted", "accepted", "not in whitelist"]


def test_log_parse_and_redact(spark):
    line = ("[driver] start trace_id=t1 instance_id=i1 biz_date=20260613 "
            "application_id=application_1_2 stmt=2/3 --keytab /etc/k/u.keytab")
    df = spark.createDataFrame([(line,)], "line string")
    r = parse_log(df).first()
    assert (r["prefix"], r["trace_id"], r["version_id"], r["stmt_index"], r["stmt_total"]) == \
        ("[driver] start", "t1", None, 2, 3)
    assert df.select(redact("line")).first()[0].endswith("--keytab ***")


def test_first_app_id(spark):
    df = spark.createDataFrame([("i", 1, "no id"), ("i", 2, "x application_5_6 y application_7_8"),
                                ("i", 3, "application_9_9"), ("j", 1, "nothing")],
                               "inst string, pos int, line string")
    got = {r["inst"]: r["application_id"] for r in first_match(df, "inst", ["pos"]).collect()}
    assert got == {"i": "application_5_6", "j": ""}


def test_transitions_flag_illegal(spark):
    ev = spark.createDataFrame(
        [("i", "2024-01-01 00:00:00", 1, "pending"), ("i", "2024-01-01 01:00:00", 2, "submitting"),
         ("i", "2024-01-02 00:00:00", 3, "running"), ("i", "2024-01-03 00:00:00", 4, "succeeded"),
         ("i", "2024-01-04 00:00:00", 5, "running")],
        "instance_id string, ts string, event_id long, state string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r["prev_state"], r["state"]): r["legal"] for r in LC.transitions(ev).collect()}
    assert got == {("start", "pending"): True, ("pending", "submitting"): True,
                   ("submitting", "running"): True, ("running", "succeeded"): True,
                   ("succeeded", "running"): False}


def test_compare_runs_null_safe(spark):
    a = spark.createDataFrame([(1, None, 1), (2, 5, 1), (3, 1, 1)], "k int, x int, y int")
    b = spark.createDataFrame([(1, None, 1), (2, 6, 2), (4, 1, 1)], "k int, x int, y int")
    got = {r["k"]: (r["status"], r["changed_cols"]) for r in LC.compare_runs(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {1: ("same", ""), 2: ("changed", "x,y"), 3: ("only_old", ""), 4: ("only_new", "")}


def test_company_dim_semantics(spark):
    base_cols = ("company_id string, company_type_code string, company_name string, oper_key_no string, "
                 "oper_name string, regist_capi string, regist_capi_curr_name string, rec_capi string, "
                 "company_status_name string, start_date string, end_date string, credit_code string, "
                 "no string, econ_kind string, econ_kind_code string, check_date string, belong_org string, "
                 "province_code string, province_name string, term_start string, term_end string, "
                 "address string, scope string, phone_number string, insert_time timestamp_ntz, "
                 "update_time timestamp_ntz, is_del string")

    def base_row(cid, code, cur, ins, upd, dele):
        vals = [cid, code, f"n{cid}"] + ["x"] * 3 + [cur] + ["x"] * 17
        return tuple(vals) + (ins, upd, dele)

    import datetime as dt
    d1, d2 = dt.datetime(2026, 6, 1, 8), dt.datetime(2026, 6, 2, 9)
    base = spark.createDataFrame([
        base_row("b1", "01", "CNY", d1, d1, "0"),      # same-day insert/update -> '1'
        base_row("b2", "01", None, d1, d2, "0"),       # NULL currency -> regist_capi NULL, '0'
        base_row("b3", "01", "CNY", d1, d2, "1"),      # deleted -> '-1'
        base_row("b4", "02", "CNY", d1, d2, "0"),      # filtered out by type code
    ], base_cols)
    mid = spark.createDataFrame([
        ("b1", "D1", d1, 1), ("b1", "D9", d2, 1),      # latest per v2 id wins: D9
        ("b2", "D2", d1, 1), ("b2", "", d2, 1),        # empty id never considered
        ("b3", "D2", d2, 1),                           # D2 also mapped from b3: target dedup keeps latest base
        ("b4", "D4", d1, 1),
    ], "v2_company_id string, dwi_company_id string, update_time timestamp_ntz, insert_time int")
    out = build(base, mid, "2026-06-13 00:00:00")
    assert out.columns == OUTPUT_COLUMNS
    rows = {r["company_id"]: r for r in out.collect()}
    assert set(rows) == {"D9", "D2"}
    assert rows["D9"]["isadd"] == "1" and rows["D9"]["regist_capi"] == "xCNY"
    # b2 and b3 both map to D2 with the same update_time; insert_time ties; company_id desc -> b3
    assert rows["D2"]["company_name"] == "nb3" and rows["D2"]["isadd"] == "-1"
    assert rows["D9"]["key_no"] is None and rows["D9"]["dates"] == "2026-06-13 00:00:00"


def test_publish_metrics_nearest_rank(spark):
    from batchwright.operators.lifecycle import publish_metrics
    rows = [("p", d, "published") for d in range(1, 101)] + [("p", 5000, "failed"), ("q", 7, "failed")]
    df = spark.createDataFrame(rows, "project_id string, duration_ms long, outcome string")
    got = {r["project_id"]: r for r in publish_metrics(df).collect()}
    p = got["p"]
    assert (p["n_publishes"], p["n_published"]) == (101, 100)
    # nearest rank over 101 values 1..100, 5000: ceil(0.5*101)=51 -> 51; ceil(0.95*101)=96 -> 96; 100 -> 100
    assert (p["p50_ms"], p["p95_ms"], p["p99_ms"]) == (51, 96, 100)
    assert got["q"]["success_rate"] == 0.0 and got["q"]["p99_ms"] == 7


def test_run_metrics_counts_null_durations_but_not_in_percentiles(spark):
    from batchwright.operators.lifecycle import run_metrics
    rows = [("t", 10, "succeeded"), ("t", 20, "failed"), ("t", None, "succeeded"), ("u", None, "failed")]
    df = spark.createDataFrame(rows, "tenant_id string, duration_s long, state string")
    got = {r["tenant_id"]: r for r in run_metrics(df).collect()}
    assert (got["t"]["n_runs"], got["t"]["n_succeeded"]) == (3, 2)
    assert (got["t"]["p50_s"], got["t"]["p99_s"]) == (10, 20)
    assert got["u"]["n_runs"] == 1 and got["u"]["p50_s"] is None and got["u"]["success_rate"] == 0.0
