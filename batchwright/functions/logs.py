"""Structured log lines (H16), redaction (H17) and first application id (F2).

Log line format: ``<prefix> key=value key=value ...``; keys with empty
values are left out by the writer, so every field is optional here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Structured keys in writing order, the application id
# pattern, and the keytab path pattern used for redaction.
LOG_KEYS = ("trace_id", "instance_id", "version_id", "task_id", "biz_date",
            "biz_hour", "timezone", "application_id")
APP_ID_PATTERN = r"application_[0-9]+_[0-9]+"
KEYTAB_PATTERN = r"[^ ='\"]+\.keytab"
REDACTED = "***"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def field(line: str | Column, key: str) -> Column:
    """Value of ``key=`` in a line, NULL when the key is absent or empty.

    The line is prefixed with a space and searched for the literal
    `` key=``: a pattern that starts with a literal lets the regex engine
    skip ahead instead of trying an alternation at every position."""
    spaced = F.concat(F.lit(" "), _c(line))
    return F.nullif(F.regexp_extract(spaced, f" {key}=([^ ]*)", 1), F.lit(""))


def parse_log(df: DataFrame, line: str = "line", keys: Sequence[str] = LOG_KEYS) -> DataFrame:
    """One column per structured key plus ``prefix`` (text before the first
    ``k=v``) and the statement counter ``stmt=i/N`` as two ints."""
    ln = _c(line)
    stmt = F.split(field(ln, "stmt"), "/")
    return df.select(
        "*",
        F.trim(F.regexp_extract(ln, r"^(.*?)(?: [A-Za-z_]+=|$)", 1)).alias("prefix"),
        *[field(ln, k).alias(k) for k in keys],
        F.element_at(stmt, 1).try_cast("int").alias("stmt_index"),
        F.element_at(stmt, 2).try_cast("int").alias("stmt_total"),
    )


def redact(line: str | Column) -> Column:
    """Keytab paths replaced by ``***`` before display."""
    return F.regexp_replace(_c(line), KEYTAB_PATTERN, REDACTED)


def first_match(df: DataFrame, key: str, order: Sequence[str], line: str = "line",
                pattern: str = APP_ID_PATTERN, out: str = "application_id") -> DataFrame:
    """per key, the first match of ``pattern`` in log order, '' when no
    line matches.  ``min`` over (order..., match) of matching lines is a
    partial aggregation, so a key with a huge log does not sit in one task."""
    m = F.regexp_extract(_c(line), pattern, 0)
    first = F.min(F.when(m != "", F.struct(*[F.col(c) for c in order], m.alias("_m"))))
    return (df.groupBy(key).agg(first.alias("_f"))
              .select(key, F.coalesce(F.col("_f._m"), F.lit("")).alias(out)))
