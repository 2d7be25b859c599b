"""Semantics of bake, version locking and dependency readiness on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from batchwright.functions.templates import bake
from batchwright.operators import lifecycle as LC
from batchwright.operators.asof import lock_versions

VAR_SCHEMA = "project_id string, name string, value string, version int, effective_at timestamp_ntz, seq long"
D = dt.datetime


def _vars(spark):
    return spark.createDataFrame([
        ("p1", "prj.lake", "lake_red", 1, D(2019, 4, 7), 1),
        ("p1", "prj.lake", "lake_blue", 2, D(2025, 11, 20), 2),
        ("p1", "prj.lake", "lake_green", 3, D(2031, 5, 2), 3),
        ("p2", "prj.lake", "pond", 7, D(2020, 8, 15), 4),
        ("p1", "prj.nested", "${prj.lake}_x", 1, D(2020, 8, 15), 5),
        ("p1", "prj.late", "never", 1, D(2033, 3, 3), 6),
        ("p1", "prj.tie", "first", 1, D(2022, 10, 9), 7),
        ("p1", "prj.tie", "second", 2, D(2022, 10, 9), 8),
    ], VAR_SCHEMA)


def _bake(spark, rows):
    sc = spark.createDataFrame(rows, "script_id long, project_id string, at timestamp_ntz, text string")
    return {r["script_id"]: r for r in bake(sc, _vars(spark)).collect()}


def test_active_version_and_runtime_kept(spark):
    out = _bake(spark, [(1, "p1", D(2026, 6, 14), "select * from ${prj.lake}.t where dt='${dt}'")])
    assert out[1]["baked"] == "select * from lake_blue.t where dt='${dt}'"
    assert out[1]["var_versions"] == "prj.lake=2" and out[1]["unresolved"] == ""


def test_projects_do_not_leak_and_future_is_unresolved(spark):
    out = _bake(spark, [(1, "p2", D(2026, 6, 14), "${prj.lake}"), (2, "p1", D(2026, 6, 14), "${prj.late} ${x}")])
    assert out[1]["baked"] == "pond"
    assert out[2]["baked"] is None and out[2]["unresolved"] == "${prj.late}, ${x}"


def test_first_stored_wins_on_equal_time(spark):
    out = _bake(spark, [(1, "p1", D(2026, 6, 14), "${prj.tie}")])
    assert out[1]["baked"] == "first" and out[1]["var_versions"] == "prj.tie=1"


def test_sequential_replacement_in_first_appearance_order(spark):
    # ${prj.nested} appears first; its value contains ${prj.lake}, replaced next
    out = _bake(spark, [(1, "p1", D(2026, 6, 14), "${prj.nested} ${prj.lake}"),
                        (2, "p1", D(2026, 6, 14), "${prj.lake} ${prj.nested}")])
    assert out[1]["baked"] == "lake_blue_x lake_blue"
    assert out[2]["baked"] == "lake_blue ${prj.lake}_x"
    assert out[1]["var_versions"] == "prj.lake=2,prj.nested=1"


def test_script_without_placeholders(spark):
    out = _bake(spark, [(1, "p1", D(2026, 6, 14), "select 1")])
    assert out[1]["baked"] == "select 1" and out[1]["var_versions"] == ""


def test_one_script_at_two_times_bakes_two_texts(spark):
    rows = [(1, "p1", D(2021, 1, 1), "use ${prj.lake}"), (1, "p1", D(2026, 1, 1), "use ${prj.lake}"),
            (1, "p2", D(2026, 1, 1), "use ${prj.lake}"), (1, "p1", D(2026, 1, 1), "and ${prj.lake} ${prj.late}"),
            (1, "p1", D(2026, 1, 1), "use ${prj.lake}"), (None, None, None, "${prj.lake}")]
    sc = spark.createDataFrame(rows, "script_id long, project_id string, at timestamp_ntz, text string")
    got = sorted(((r["baked"], r["var_versions"], r["unresolved"]) for r in bake(sc, _vars(spark)).collect()), key=repr)
    assert got == sorted([("use lake_red", "prj.lake=1", ""), ("use lake_blue", "prj.lake=2", ""),
                          ("use lake_blue", "prj.lake=2", ""), ("use pond", "prj.lake=7", ""),
                          (None, "prj.lake=2", "${prj.late}"), (None, "", "${prj.lake}")], key=repr)
    from batchwright.functions.templates import unresolved
    assert sorted((r[0] or 0, r[1]) for r in unresolved(sc, _vars(spark)).collect()) == [(0, "${prj.lake}"), (1, "${prj.late}")]


def _history(spark):
    from batchwright.operators.asof import publish_history
    versions = spark.createDataFrame([
        ("t", 10, D(2024, 2, 3), "superseded"), ("t", 11, D(2024, 5, 6), "superseded"),
        ("t", 12, D(2024, 9, 9), "published"), ("t", 13, D(2024, 10, 1), "baked")],
        "task_id string, version_id long, baked_at timestamp_ntz, status string")
    rollbacks = spark.createDataFrame([("t", D(2024, 7, 1), 10, 1), ("t", D(2024, 9, 9), 11, 2)],
                                      "task_id string, rolled_at timestamp_ntz, version_id long, rollback_id long")
    return versions, rollbacks, publish_history(versions, rollbacks)


def test_lock_reads_the_pointer_of_its_moment(spark):
    _, _, history = _history(spark)
    inst = spark.createDataFrame([
        (1, "i1", "t", D(2024, 3, 1), None),    # first attempt: 10, though superseded since
        (2, "i1", "t", D(2024, 6, 1), None),    # retry after 11 was published: still 10
        (3, "i2", "t", D(2024, 6, 1), None),    # 11, though superseded since
        (4, "i3", "t", D(2024, 8, 1), None),    # after the rollback to 10
        (5, "i4", "t", D(2024, 9, 9), None),    # 12 was published and rolled back from at this instant
        (6, "i5", "t", D(2024, 8, 1), 12),      # backfill with explicit version
        (7, "i6", "t", D(2023, 1, 1), None),    # nothing published yet
        (8, "i7", "t", D(2025, 1, 1), None),    # 13 was baked and never published
    ], "attempt_id long, instance_id string, task_id string, created_at timestamp_ntz, explicit_version long")
    got = {r["attempt_id"]: (r["locked_version"], r["lock_source"]) for r in lock_versions(inst, history).collect()}
    assert got == {1: (10, "published"), 2: (10, "published"), 3: (11, "published"), 4: (10, "published"),
                   5: (11, "published"), 6: (12, "explicit"), 7: (None, "none"), 8: (11, "published")}


def test_pointer_and_lock_agree(spark):
    versions, rollbacks, history = _history(spark)
    points = sorted(tuple(r) for r in LC.published_pointer(versions, rollbacks).collect())
    assert [(k, v, p) for _, _, k, v, p in points] == [
        ("publish", 10, 10), ("publish", 11, 11), ("rollback", 10, 10), ("publish", 12, 12), ("rollback", 11, 11),
        ("bake", 13, 11)]
    for max_rows in (1, 2):
        assert points == sorted(tuple(r) for r in LC.published_pointer(versions, rollbacks, max_rows=max_rows).collect())
    inst = spark.createDataFrame([(i, str(i), "t", at, None) for i, (_, at, _, _, _) in enumerate(points)],
                                 "attempt_id long, instance_id string, task_id string, created_at timestamp_ntz, explicit_version long")
    locks = {r["attempt_id"]: r["locked_version"] for r in lock_versions(inst, history).collect()}
    last = {at: p for _, at, _, _, p in points}
    assert locks == {i: last[at] for i, (_, at, _, _, _) in enumerate(points)}


def test_ready_reduces_attempts(spark):
    d = dt.date
    inst = spark.createDataFrame([
        ("A", d(2026, 6, 13), False, 1), ("A", d(2026, 6, 13), True, 2),     # failed, then succeeded
        ("B", d(2026, 6, 13), True, 1), ("B", d(2026, 6, 13), False, 2),     # rerun failed
        ("C", d(2026, 6, 13), None, 1), ("D", d(2026, 6, 13), None, 1)],
        "task_id string, biz_date date, ok boolean, attempt int")
    deps = spark.createDataFrame([("C", "A", 0), ("C", "A", 0), ("D", "B", 0)], "task_id string, upstream_id string, offset int")
    got = {r["task_id"]: (r["n_deps"], r["state"]) for r in LC.ready(inst, deps).collect()}
    assert got["C"] == (1, "submitting") and got["D"] == (1, "submitting") and len(got) == 4
    got = {r["task_id"]: r["state"] for r in LC.ready(inst, deps, order=["attempt"]).collect()}
    assert got["C"] == "submitting" and got["D"] == "waiting_dependency"


def test_recovered_needs_a_success_after_the_failure(spark):
    rows = [("a", 1, "failed"), ("a", 2, "succeeded"), ("b", 1, "succeeded"), ("b", 2, "failed"), ("c", 1, "succeeded")]
    ev = spark.createDataFrame([(i, k, D(2026, 1, n), s) for i, (k, n, s) in enumerate(rows)],
                               "event_id long, instance_id string, ts timestamp_ntz, state string")
    assert {r["instance_id"]: r["recovered"] for r in LC.retry_stats(ev).collect()} == {"a": True, "b": False, "c": False}


def test_audit_diff_presence_null_and_broken_texts(spark):
    rows = [(1, '{"a": 1}', '{"a": null}'), (2, '{"a": null}', '{"a": 1}'), (3, "{}", '{"a": null}'), (4, '{"a": null}', "{}"),
            (5, '{"a": 1', '{"a": 1}'), (6, None, '{"a": 1}'), (7, '{"a": 1}', '{"a": 1}'), (8, None, None)]
    got = sorted((r["id"], r["field"], r["before"], r["after"], r["change"])
                 for r in LC.audit_diff(spark.createDataFrame(rows, "id long, before_json string, after_json string")).collect())
    assert got == [(1, "a", "1", None, "changed"), (2, "a", None, "1", "changed"), (3, "a", None, None, "added"),
                   (4, "a", None, None, "removed"), (5, None, '{"a": 1', '{"a": 1}', "malformed"), (6, "a", None, "1", "added")]


def test_reversed_backfill_range_has_no_days(spark):
    from batchwright.functions.bizdate import backfill, backfill_error
    d = dt.date
    df = spark.createDataFrame([(1, d(2026, 1, 2), d(2026, 1, 3)), (2, d(2026, 1, 3), d(2026, 1, 2)), (3, None, d(2026, 1, 1))],
                               "id long, s date, e date")
    assert sorted((r["id"], r["biz_date"]) for r in backfill(df, "s", "e").collect()) == [(1, "20260102"), (1, "20260103")]
    assert {r["id"]: r["x"] for r in df.select("id", backfill_error("s", "e").alias("x")).collect()} == {
        1: None, 2: "range ends 2026-01-02 before its start 2026-01-03", 3: "range lacks a start or an end"}


def test_coverage_and_adapter_errors(spark):
    logs = spark.createDataFrame([("i", None), ("i", "t1"), ("j", None)], "instance_id string, trace_id string")
    r = LC.instance_coverage(logs).first()
    assert (r["n_instances"], r["n_present"], r["coverage"]) == (2, 1, 0.5)
    calls = spark.createDataFrame([("x", "ok"), ("x", None), ("x", "timeout"), ("y", "ok")], "operation string, outcome string")
    assert {r["operation"]: (r["n_calls"], r["n_errors"]) for r in LC.adapter_metrics(calls).collect()} == {"x": (3, 2), "y": (1, 0)}


def test_ready_needs_every_upstream_succeeded(spark):
    d = dt.date
    inst = spark.createDataFrame([
        ("A", d(2026, 6, 13), True), ("B", d(2026, 6, 13), False), ("C", d(2026, 6, 13), None),
        ("A", d(2026, 6, 12), True), ("D", d(2026, 6, 13), None), ("E", d(2026, 6, 13), None)],
        "task_id string, biz_date date, ok boolean")
    deps = spark.createDataFrame([
        ("C", "A", 0), ("C", "B", 0),       # B failed -> C waits
        ("D", "A", 1),                      # A yesterday ok -> D ready
        ("E", "Z", 0)],                     # upstream never created -> waits
        "task_id string, upstream_id string, offset int")
    got = {r["task_id"]: r["state"] for r in LC.ready(inst, deps).filter(F.col("biz_date") == d(2026, 6, 13)).collect()}
    assert got == {"A": "submitting", "B": "submitting", "C": "waiting_dependency",
                   "D": "submitting", "E": "waiting_dependency"}


def test_preview_bakes_then_renders(spark):
    from batchwright.functions.templates import preview
    sc = spark.createDataFrame([
        (1, "p1", D(2026, 6, 14), "20260614", "03", "select '${dt-1}', '${hr}' from ${prj.lake}.t"),
        (2, "p1", D(2026, 6, 14), "20260614", "03", "select * from ${prj.late}"),
        (3, "p1", D(2026, 6, 14), "20260614", None, "select '${hr}'"),
        (4, "p1", D(2026, 6, 14), "20260614", "03", "${prj.dated}"),
        (5, "p1", D(2026, 6, 14), "20260614", "03", "${prj.nested}"),
        (6, "p1", D(2026, 6, 14), "20260614", None, "${prj.nested} ${hr}"),
    ], "script_id long, project_id string, at timestamp_ntz, biz_date string, biz_hour string, text string")
    vars_ = spark.createDataFrame([("p1", "prj.dated", "db_${dt}", 1, D(2026, 1, 1), 9)], VAR_SCHEMA)
    out = {r["script_id"]: r for r in preview(sc, _vars(spark).unionByName(vars_)).collect()}
    assert out[1]["preview"] == "select '20260613', '03' from lake_blue.t" and out[1]["error"] is None
    assert out[2]["preview"] is None and out[2]["error"] == "publish blocked - unknown placeholders: ${prj.late}"
    assert out[3]["preview"] is None and out[3]["error"] == "no business hour for ${hr}"
    # a catalog placeholder inside a baked value is rendered by the preview;
    # a project one is not baked again, so the strict render rejects it,
    # unless a missing input comes first
    assert out[4]["preview"] == "db_20260614"
    assert out[5]["preview"] is None and out[5]["error"] == "SQL contains undeclared variables: ${prj.lake}"
    assert out[6]["error"] == "no business hour for ${hr}"


def test_catalog_match_literal_and_parameterised(spark):
    from batchwright.functions.templates import match_catalog
    cases = ["${dt}", "${date}", "${month}", "${hr}", "${dt-0}", "${dt-7}", "${dt-07}", "${date-365}",
             "${date-}", "${dt-1abc}", "${DT}", "${dtx}", "${prj.a}"]
    want = ["dt", "date", "month", "hr", "dt-N", "dt-N", None, "date-N", None, None, None, None, None]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = [r[0] for r in df.select(match_catalog(F.col("p"))).collect()]
    assert got == want


def test_project_scan_equals_filtered_full_scan(spark):
    from batchwright.functions.templates import PROJECT_SCAN_PATTERN, placeholders, placeholder_name
    texts = ["${prj.a} ${dt} ${prj.b}${prj.a}", "$${prj.x}} ${prj.} ${prj-a} ${ prj.a} ${prj.a.b-c}",
             "${x${prj.y}", "no placeholders", "${Prj.z} ${prj.z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    full = F.filter(placeholders("t"), lambda p: placeholder_name(p).startswith("prj."))
    fast = F.array_distinct(F.regexp_extract_all(F.col("t"), F.lit(PROJECT_SCAN_PATTERN), 0))
    for r in df.select(full.alias("a"), fast.alias("b")).collect():
        assert r["a"] == r["b"]


def test_bake_versions_once_runtime_only_and_unknown_names(spark):
    vars_ = spark.createDataFrame([("p1", "prj.x", "vx", 4, D(2026, 1, 1), 1),
                                   ("p1", "prj.y", "vy", 7, D(2026, 1, 1), 2)], VAR_SCHEMA)
    sc = spark.createDataFrame([
        (1, "p1", D(2026, 6, 14), "${prj.x} ${prj.y} ${prj.x}"),
        (2, "p1", D(2026, 6, 14), "SELECT '${dt}', '${hr}'"),
        (3, "p1", D(2026, 6, 14), "SELECT ${prj-foo}"),
        (4, "p1", D(2026, 6, 14), "SELECT ${prj.nope}"),
    ], "script_id long, project_id string, at timestamp_ntz, text string")
    out = {r["script_id"]: r for r in bake(sc, vars_).collect()}
    assert (out[1]["baked"], out[1]["var_versions"]) == ("vx vy vx", "prj.x=4,prj.y=7")
    assert (out[2]["baked"], out[2]["var_versions"], out[2]["unresolved"]) == ("SELECT '${dt}', '${hr}'", "", "")
    assert out[3]["baked"] is None and out[3]["unresolved"] == "${prj-foo}"
    assert out[4]["baked"] is None and out[4]["unresolved"] == "${prj.nope}"
