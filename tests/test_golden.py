"""Golden date-variable pairs from the runtime-variable contract, rendered by
the column renderer, plus the rejected inputs."""

import pytest
from pyspark.sql import functions as F

from batchwright.functions.templates import match_catalog, render

# Fixed values: (template, biz_date, biz_hour, expected output) from the contract examples.
GOLDEN = [
    ("${dt}", "20260613", None, "20260613"),
    ("${date}", "20260613", None, "2026-06-13"),
    ("${month}", "20260613", None, "202606"),
    ("${dt-0}", "20260613", None, "20260613"),
    ("${dt-1}", "20260613", None, "20260612"),
    ("${dt-7}", "20260613", None, "20260606"),
    ("${dt-1}", "20260601", None, "20260531"),
    ("${dt-1}", "20260101", None, "20251231"),
    ("${dt-1}", "20260301", None, "20260228"),
    ("${date-0}", "20260613", None, "2026-06-13"),
    ("${date-1}", "20260613", None, "2026-06-12"),
    ("${date-30}", "20260613", None, "2026-05-14"),
    ("${date-1}", "20260101", None, "2025-12-31"),
    ("${hr}", "20260613", "00", "00"),
    ("${hr}", "20260613", "03", "03"),
    ("${hr}", "20260613", "23", "23"),
    ("${dt-365}", "20260613", None, "20250613"),
]


def _render(spark, rows):
    df = spark.createDataFrame(rows, "text string, biz_date string, biz_hour string")
    return [r["r"] for r in df.select(render("text", "biz_date", "biz_hour").alias("r")).collect()]


def test_golden_pairs(spark):
    out = _render(spark, [(t, d, h) for t, d, h, _ in GOLDEN])
    assert [r["text"] for r in out] == [e for *_, e in GOLDEN]
    assert all(r["error"] is None and r["unresolved"] == [] for r in out)


def test_full_placeholder_replaced_not_prefix(spark):
    (r,) = _render(spark, [("a ${dt} b ${dt-7} c ${dt}", "20260613", None)])
    assert r["text"] == "a 20260613 b 20260606 c 20260613"


@pytest.mark.parametrize("bad", ["${dt-01}", "${dt-1abc}", "${not_declared}", "${date-007}"])
def test_undeclared(spark, bad):
    (r,) = _render(spark, [(f"x {bad} y", "20260613", None)])
    assert r["unresolved"] == [bad]
    assert r["text"] == f"x {bad} y"
    assert r["error"] is None


def test_not_a_placeholder_is_ignored(spark):
    (r,) = _render(spark, [("${not a var} ${dt}", "20260613", None)])
    assert r["text"] == "${not a var} 20260613" and r["unresolved"] == []


@pytest.mark.parametrize("hour", ["24", "3", "ab"])
def test_bad_hour_rejected(spark, hour):
    (r,) = _render(spark, [("${hr}", "20260613", hour)])
    assert r["text"] is None and r["error"] == f"not a business hour (00 to 23): {hour}"


def test_missing_hour_is_an_error(spark):
    (r,) = _render(spark, [("${dt} ${hr}", "20260613", None)])
    assert r["text"] is None and r["error"] == "no business hour for ${hr}"


@pytest.mark.parametrize("date", ["2026-06-13", "2026061", "20261340"])
def test_bad_date_rejected(spark, date):
    (r,) = _render(spark, [("${dt}", date, None)])
    assert r["text"] is None and r["error"].startswith("not a business date: ")


def test_first_catalog_match_wins(spark):
    df = spark.createDataFrame([("${dt}",), ("${dt-3}",), ("${hr}",), ("${month}",), ("${x}",)], "p string")
    got = [r[0] for r in df.select(match_catalog(F.col("p"))).collect()]
    assert got == ["dt", "dt-N", "hr", "month", None]


def test_render_is_idempotent(spark):
    (r1,) = _render(spark, [("select '${dt}', '${date-3}', '${prj.x}'", "20260301", None)])
    (r2,) = _render(spark, [(r1["text"], "20260301", None)])
    assert r2["text"] == r1["text"]


def test_run_query_strict_and_lenient(spark):
    from batchwright.functions.bizdate import run_query
    r = run_query(spark, "SELECT '${dt}' AS d, '${dt-1}' AS y", "20260613").first()
    assert (r["d"], r["y"]) == ("20260613", "20260612")
    with pytest.raises(ValueError, match="undeclared"):
        run_query(spark, "SELECT '${x}' AS v", "20260613")
    with pytest.raises(ValueError, match="no business hour"):
        run_query(spark, "SELECT '${hr}' AS h", "20260613")
    kept = run_query(spark, "SELECT '${x}' AS v, '${dt}' AS d", "20260613", strict=False).first()
    assert (kept["v"], kept["d"]) == ("${x}", "20260613")
    assert spark.conf.get("spark.sql.variable.substitute", "true") == "true"


def test_errors_follow_placeholder_order_and_gating(spark):
    rows = [
        ("a ${dt-1000000} b", "20260613", "03"),        # offset beyond 0001-01-01
        ("${date-99999999999}", "20260613", "03"),      # N does not fit an int
        ("${dt}", None, "03"),                          # date missing
        ("${hr} ${dt-1000000}", "20260613", None),      # hour error comes first
        ("${dt-1000000} ${hr}", "20260613", None),      # offset error comes first
        ("${hr} only", None, "03"),                     # no date needed: renders
        ("${month} ${x}", "2026-06-13", "03"),          # malformed date
        ("${dt-01} ${dt-3}", "20260613", None),         # undeclared kept, no error
    ]
    out = _render(spark, rows)
    assert [r["error"] for r in out] == [
        "date offset out of range in ${dt-1000000}",
        "date offset out of range in ${date-99999999999}",
        "no business date for ${dt}",
        "no business hour for ${hr}",
        "date offset out of range in ${dt-1000000}",
        None,
        "not a business date: 2026-06-13",
        None,
    ]
    assert [r["text"] for r in out][5:] == ["03 only", None, "${dt-01} 20260610"]
    assert out[7]["unresolved"] == ["${dt-01}"]


def test_render_error_equals_render_struct_error(spark):
    from batchwright.functions.templates import render_error
    rows = [("a ${dt-1000000} b", "20260613", "03"), ("${date-99999999999}", "20260613", "03"),
            ("${dt}", None, "03"), ("${hr} ${dt-1000000}", "20260613", None),
            ("${dt-1000000} ${hr}", "20260613", None), ("${hr} only", None, "03"),
            ("${month} ${x}", "2026-06-13", "03"), ("${dt-01} ${dt-3}", "20260613", None),
            ("${hr}", "20260613", "24"), ("$${dt}}{${hr}", "19991231", "23"), (None, "20260613", "01"),
            ("${dt-739779} ${dt-739780}", "20260613", "01"), ("no vars", None, None), ("${dt}", "20260613", "03")]
    df = spark.createDataFrame(rows, "text string, biz_date string, biz_hour string")
    got = df.select(render("text", "biz_date", "biz_hour")["error"].alias("a"),
                    render_error("text", "biz_date", "biz_hour").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert sum(r["a"] is not None for r in got) == 8
