"""Business date and hour columns (H6-H11), backfill expansion (H19), and the
date-parameterised query (U2, B10, H5).

Dates are ``DateType`` inside and strings only at the edge.  No wall clock is
read anywhere: every value derives from the business date and hour given.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Business date / hour text formats.
FMT_DT = "yyyyMMdd"
FMT_DATE = "yyyy-MM-dd"
FMT_MONTH = "yyyyMM"
HOUR_PATTERN = "^([01][0-9]|2[0-3])$"
BIZ_DATE_PATTERN = "^[0-9]{8}$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_biz_date(text: str | Column) -> Column:
    """``yyyyMMdd`` text -> DATE, NULL when malformed (never raises)."""
    t = _c(text)
    return F.when(t.rlike(BIZ_DATE_PATTERN), F.try_to_date(t, FMT_DT))


def biz_hour(text: str | Column) -> Column:
    """The hour text when it is exactly two digits 00-23, else NULL."""
    t = _c(text)
    return F.when(t.rlike(HOUR_PATTERN), t)


def dt(d: Column, n: int | Column = 0) -> Column:
    """H6/H9: ``yyyyMMdd`` of d minus n days."""
    return F.date_format(F.date_sub(d, n) if not (isinstance(n, int) and n == 0) else d, FMT_DT)


def date_text(d: Column, n: int | Column = 0) -> Column:
    """``yyyy-MM-dd`` of d minus n days."""
    return F.date_format(F.date_sub(d, n) if not (isinstance(n, int) and n == 0) else d, FMT_DATE)


def month(d: Column) -> Column:
    """H8: ``yyyyMM``."""
    return F.date_format(d, FMT_MONTH)


def biz_cols(d: Column, lags: Iterable[int] = (), date_lags: Iterable[int] = (),
             hour: Column | None = None) -> list[Column]:
    """All business-date columns for a DATE column ``d``."""
    cols = [dt(d).alias("dt"), date_text(d).alias("date"), month(d).alias("month")]
    cols += [dt(d, n).alias(f"dt_{n}") for n in lags]
    cols += [date_text(d, n).alias(f"date_{n}") for n in date_lags]
    if hour is not None:
        cols.append(biz_hour(hour).alias("hr"))
    return cols


def for_date(df: DataFrame, biz_date: str, col: str = "dt") -> DataFrame:
    """Rows of one business date; on a table partitioned by ``col`` this
    is a partition filter and prunes the scan."""
    return df.filter(F.col(col) == F.lit(biz_date))


def backfill(df: DataFrame, start: str | Column, end: str | Column,
             version: str | Column | None = None, out: str = "biz_date") -> DataFrame:
    """One row per day in [start, end] (DATE columns or ``yyyyMMdd``
    text) for each input row, with the chosen version (NULL = the currently
    published one, resolved at lock time).  A range whose end is before its
    start, or that lacks one of them, has no days (``backfill_error`` names it)."""
    s = parse_biz_date(start) if isinstance(start, str) and start.isdigit() else _c(start)
    e = parse_biz_date(end) if isinstance(end, str) and end.isdigit() else _c(end)
    v = F.lit(None).cast("string") if version is None else _c(version).cast("string")
    days = F.when(s <= e, F.sequence(s, F.greatest(s, e), F.expr("INTERVAL 1 DAY")))
    return (df.withColumn("_day", F.explode(days))
              .withColumn(out, dt(F.col("_day")))
              .withColumn("version_choice", v)
              .drop("_day"))


def backfill_error(start: str | Column, end: str | Column) -> Column:
    """H18 for a backfill range: what is wrong with it, NULL when nothing is."""
    s, e = _c(start), _c(end)
    return (F.when(s.isNull() | e.isNull(), F.lit("range lacks a start or an end"))
             .when(e < s, F.concat(F.lit("range ends "), date_text(e), F.lit(" before its start "), date_text(s))))


def run_query(spark: SparkSession, sql: str, biz_date: str, biz_hour_text: str | None = None,
              strict: bool = True) -> DataFrame:
    """Render the runtime placeholders of one SQL text for (date, hour) and
    hand it to ``spark.sql``.

    The text is rendered by the same column function that renders whole
    template tables (``templates.render``), on a one-row literal frame, so a previewed
    table of scripts and a run of one script produce the same text.
    """
    from batchwright.functions.templates import render

    hour = F.lit(biz_hour_text).cast("string")
    row = spark.range(1).select(render(F.lit(sql), F.lit(biz_date), hour).alias("r")).first()["r"]
    if row["error"]:
        raise ValueError(row["error"])
    if strict and row["unresolved"]:
        raise ValueError("SQL contains undeclared variables: " + ", ".join(sorted(row["unresolved"])))
    if not row["unresolved"]:
        return spark.sql(row["text"])
    # Kept placeholders must reach the statement verbatim: Spark's own
    # ``${...}`` substitution would turn unknown names into empty strings, so
    # it is switched off for this parse only (spark.sql parses eagerly).
    key = "spark.sql.variable.substitute"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return spark.sql(row["text"])
    finally:
        spark.conf.set(key, before)
