"""Template scanning, catalog matching, rendering and baking as column work
(H12, D1, C3, H13, H14, D2, D3, C4).

A catalog of tasks times a backfill range is millions of rendered scripts, so
scripts are a column of a table and every step is a native expression:
``regexp_extract_all`` finds placeholders, ``array_distinct`` keeps their
first-appearance order, and ``replace`` puts in their values.  No Python runs
per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.functions.bizdate import biz_hour, date_text, dt, month, parse_biz_date

# Placeholder scan pattern and the runtime variable catalog
# (name, full-match pattern, required input), in declared order; the first
# full match wins.  Capture group 1 of the parameterised ones is N.
SCAN_PATTERN = r"\$\{[A-Za-z_][A-Za-z0-9_.\-]*\}"
CATALOG = [
    ("dt", r"^\$\{dt\}$", "biz_date"),
    ("date", r"^\$\{date\}$", "biz_date"),
    ("month", r"^\$\{month\}$", "biz_date"),
    ("dt-N", r"^\$\{dt-([1-9][0-9]*|0)\}$", "biz_date"),
    ("date-N", r"^\$\{date-([1-9][0-9]*|0)\}$", "biz_date"),
    ("hr", r"^\$\{hr\}$", "biz_hour"),
]
PROJECT_PREFIX = "prj."
# The placeholders of SCAN_PATTERN whose name starts with PROJECT_PREFIX.
# Tokens never overlap or contain "$", so this finds exactly those, in the
# same order; its literal start lets the regex engine skip ahead.
PROJECT_SCAN_PATTERN = r"\$\{prj\.[A-Za-z0-9_.\-]*\}"

# Error text of a blocked bake and of a strict render.
BAKE_BLOCKED = "publish blocked - unknown placeholders: "
UNDECLARED = "SQL contains undeclared variables: "
# Error texts of this library for inputs that a placeholder needs.
NO_DATE, BAD_DATE = "no business date for ", "not a business date: "
NO_HOUR, BAD_HOUR = "no business hour for ", "not a business hour (00 to 23): "
FAR_OFFSET = "date offset out of range in "


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def placeholders(text: str | Column) -> Column:
    """H12 + D1: distinct placeholders of a text in order of first appearance.
    Placeholders inside comments and string literals count too."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(SCAN_PATTERN), 0))


def placeholder_name(p: Column) -> Column:
    """``${prj.foo}`` -> ``prj.foo``."""
    return p.substr(F.lit(3), F.length(p) - F.lit(3))


def _literal_text(body: str) -> str:
    return re.sub(r"\\(.)", r"\1", body)


def _catalog_test(p: Column, pattern: str) -> Column:
    """Full match of ``p`` against one catalog pattern.  A pattern without
    regex operators is plain text and compares by equality; otherwise its
    literal prefix is checked first, so the regex only runs on candidates."""
    body = pattern[1:-1]  # the catalog patterns are anchored ^...$
    if not re.search(r"[\[\](){}|*+?.^$]", re.sub(r"\\.", "", body)):
        return p == F.lit(_literal_text(body))
    prefix = _literal_text(re.match(r"(?:\\.|[^\\\[\](){}|*+?.^$])*", body).group(0))
    return p.startswith(prefix) & p.rlike(pattern)


def match_catalog(p: Column) -> Column:
    """Name of the first catalog variable whose pattern fully matches the
    placeholder, NULL when none does.  The catalog is a fixed list, so the
    match is a CASE chain inside the projection: no join, no shuffle."""
    expr = None
    for name, pattern, _ in CATALOG:
        cond = _catalog_test(p, pattern)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def _offset(p: Column, name: str) -> Column:
    pattern = dict((n, pt) for n, pt, _ in CATALOG)[name]
    return F.regexp_extract(p, pattern, 1).try_cast("int")


def _fits(d: Column, n: Column) -> Column:
    # d - n must stay on or after 0001-01-01, as in the reference's date arithmetic
    return n.isNotNull() & (n <= F.datediff(d, F.lit("0001-01-01").cast("date")))


def _error(p: Column, var: Column, n: Column, date_text_col: Column, d: Column, h: Column) -> Column:
    needs_date = var.isin("dt", "date", "month", "dt-N", "date-N")
    return (F.when(needs_date & date_text_col.isNull(),
                   F.concat(F.lit(NO_DATE), p))
             .when(needs_date & d.isNull(),
                   F.concat(F.lit(BAD_DATE), date_text_col))
             .when(var.isin("dt-N", "date-N") & ~_fits(d, n),
                   F.concat(F.lit(FAR_OFFSET), p))
             .when((var == "hr") & h.isNull(),
                   F.concat(F.lit(NO_HOUR), p))
             .when((var == "hr") & biz_hour(h).isNull(),
                   F.concat(F.lit(BAD_HOUR), h)))


# The catalog's parameterised variables as they stand in a text.
OFFSET_SCAN_PATTERN = r"\$\{(?:dt|date)-(?:[1-9][0-9]*|0)\}"
FAR_OFFSET_PATTERN = r"\$\{(?:dt|date)-[1-9][0-9]{5,}\}"


def _with_offsets(t: Column, out: Column, d: Column) -> Column:
    """``out`` with every ``${dt-N}`` and ``${date-N}`` of ``t`` replaced that has a value."""
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(OFFSET_SCAN_PATTERN), 0))

    def value(p: Column) -> Column:
        n = F.regexp_extract(p, r"([0-9]+)", 1).try_cast("int")
        return F.when(_fits(d, n), F.when(p.startswith("${dt-"), dt(d, n)).otherwise(date_text(d, n)))

    return F.aggregate(found, out, lambda acc, p: F.replace(acc, p, F.coalesce(value(p), p)))


def render(text: str | Column, biz_date: str | Column, hour: str | Column | None = None) -> Column:
    """Render every catalog placeholder of ``text`` for a business date
    (``yyyyMMdd`` text) and hour (``HH`` text or NULL).

    Returns struct(text, unresolved, error):
      * ``unresolved``: placeholders the catalog does not declare, in order of
        first appearance; they stay in the text (strict callers reject them);
      * ``error``: the first configuration error in placeholder order (a
        required input missing or invalid); ``text`` is NULL then.

    Values are digits and dashes, so no replacement can make or break another
    placeholder and their order is free: the four fixed names are chained
    ``replace`` calls, and only the ``-N`` ones need a fold over what the text
    holds.
    """
    t = _c(text)
    dtxt = _c(biz_date)
    h = F.lit(None).cast("string") if hour is None else _c(hour)
    d = parse_biz_date(dtxt)
    out = t
    for name, value in (("dt", dt(d)), ("date", date_text(d)), ("month", month(d)), ("hr", biz_hour(h))):
        p = F.lit(f"${{{name}}}")
        out = F.replace(out, p, F.coalesce(value, p))
    error = render_error(text, biz_date, hour)
    return F.struct(F.when(error.isNull(), _with_offsets(t, out, d)).alias("text"),
                    F.filter(placeholders(t), lambda p: match_catalog(p).isNull()).alias("unresolved"),
                    error.alias("error"))


def render_error(text: str | Column, biz_date: str | Column, hour: str | Column | None = None) -> Column:
    """H13's error alone.  The per-placeholder check runs only on rows where an
    error is possible at all (a date or hour missing or invalid, or a
    ``${dt-N}`` / ``${date-N}`` offset that may pass 0001-01-01); other rows
    cost one search for long offsets."""
    t = _c(text)
    dtxt = _c(biz_date)
    h = F.lit(None).cast("string") if hour is None else _c(hour)
    d = parse_biz_date(dtxt)

    def first_error(p: Column) -> Column:
        var = match_catalog(p)
        n = F.when(var == "dt-N", _offset(p, "dt-N")).when(var == "date-N", _offset(p, "date-N"))
        return _error(p, var, n, dtxt, d, h)

    ph = placeholders(t)
    # an offset of up to five digits fits every date that many days after 0001-01-01
    far = (F.datediff(d, F.lit("0001-01-01").cast("date")) < 99_999) | t.rlike(FAR_OFFSET_PATTERN)
    possible = dtxt.isNull() | d.isNull() | h.isNull() | biz_hour(h).isNull() | far
    return F.when(possible, F.aggregate(ph, F.lit(None).cast("string"),
                                        lambda acc, p: F.coalesce(acc, first_error(p))))


def failures(arr: Column, sep: str = ", ") -> Column:
    """D3: sorted, de-duplicated, comma-joined list (empty string when none)."""
    return F.array_join(F.array_sort(F.array_distinct(arr)), sep)


def scan(scripts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """H12/D1 exploded: (id, pos, placeholder, variable, is_project) per
    distinct placeholder, ``pos`` = order of first appearance (0-based)."""
    return (scripts.select(id_col, F.posexplode(placeholders(text_col)).alias("pos", "placeholder"))
            .withColumn("variable", match_catalog(F.col("placeholder")))
            .withColumn("is_project", placeholder_name(F.col("placeholder")).startswith(PROJECT_PREFIX)))


def is_project(p: Column) -> Column:
    return placeholder_name(p).startswith(PROJECT_PREFIX)


def undeclared(text: str | Column) -> Column:
    """C4 within a row: runtime placeholders that the catalog does not declare."""
    return F.filter(placeholders(text), lambda p: ~is_project(p) & match_catalog(p).isNull())


def resolve(scripts: DataFrame, variables: DataFrame, ids: Sequence[str], text_col: str = "text",
            project_col: str = "project_id", at_col: str = "at", max_rows: int | None = None) -> DataFrame:
    """The project placeholders of every script row with the value active at its
    time: (ids, project, at, pos, placeholder, name, value, version).  Only the
    ids and placeholders are shuffled, never a text."""
    from batchwright.operators.asof import as_of_join

    found = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(PROJECT_SCAN_PATTERN), 0))
    keep = dict.fromkeys([*ids, project_col, at_col])
    prj = (scripts.select(*keep, F.posexplode(found).alias("pos", "placeholder"))
           .withColumn("name", placeholder_name(F.col("placeholder"))))
    return as_of_join(prj, variables.withColumnRenamed("project_id", project_col),
                      keys=[project_col, "name"], left_ts=at_col, right_ts="effective_at",
                      right_cols=["value", "version"], tie="seq", **({"max_rows": max_rows} if max_rows else {}))


def unresolved(scripts: DataFrame, variables: DataFrame, id_col: str = "script_id", text_col: str = "text",
               **options) -> DataFrame:
    """C4: (id, placeholder) for every placeholder of a script row that nothing
    resolves; no join back to the scripts and no text in a shuffle."""
    missing = resolve(scripts, variables, [id_col], text_col, **options).where("value is null")
    return missing.select(id_col, "placeholder").unionByName(
        scripts.select(id_col, F.explode(undeclared(text_col)).alias("placeholder")))


def bake(scripts: DataFrame, variables: DataFrame, id_col: str = "script_id",
         text_col: str = "text", project_col: str = "project_id", at_col: str = "at",
         max_rows: int | None = None) -> DataFrame:
    """H14 + D2 + D3 + C4: replace project variables (``${prj.*}``) with the
    value active at ``at`` for the script's project; keep runtime placeholders.

    ``variables``: (project_id, name, value, version, effective_at, seq).

    Returns the scripts with ``baked`` (NULL when anything is unresolved),
    ``var_versions`` (``name=version`` pairs sorted by name, each once) and
    ``unresolved`` (sorted, comma-joined).

    Every row is baked for itself, so one script at two times (a backfill) gets
    two texts.  A row is known by its id, project, time and a hash of its text;
    rows equal in all of these have equal results.

    Plan: only the project placeholders are exploded (a few per script) and
    resolved; their results are collected per row (bounded by its distinct
    placeholders) and joined back to the scripts once, where ``aggregate``
    applies them in order of first appearance.  Runtime placeholders never
    leave their row: the undeclared ones are found in the final projection.
    """
    key = F.struct(F.col(id_col), F.col(project_col), F.col(at_col), F.xxhash64(text_col))
    rows = scripts.withColumn("_row", key)
    resolved = resolve(rows, variables, ["_row"], text_col, project_col, at_col, max_rows)
    per_row = resolved.groupBy("_row").agg(F.array_sort(F.collect_set(
        F.struct("pos", "placeholder", "name", "value", "version"))).alias("items"))
    per_row = per_row.select(
        F.col("_row").alias("_of"),
        F.filter("items", lambda x: x["value"].isNotNull()).alias("repl"),
        F.transform(F.filter("items", lambda x: x["value"].isNull()), lambda x: x["placeholder"]).alias("_missing"),
        F.array_join(F.array_sort(F.transform(
            F.filter("items", lambda x: x["version"].isNotNull()),
            lambda x: F.concat(x["name"], F.lit("="), x["version"].cast("string")))), ",").alias("var_versions"),
    )
    out = rows.join(per_row, F.col("_row").eqNullSafe(F.col("_of")), "left")
    empty = F.array().cast("array<string>")
    baked = F.aggregate(F.coalesce(F.col("repl"), F.array().cast(
        "array<struct<pos:int,placeholder:string,name:string,value:string,version:int>>")),
        F.col(text_col), lambda acc, x: F.replace(acc, x["placeholder"], x["value"]))
    return (out.withColumn("unresolved", failures(F.concat(F.coalesce(F.col("_missing"), empty), undeclared(text_col))))
               .withColumn("var_versions", F.coalesce(F.col("var_versions"), F.lit("")))
               .withColumn("baked", F.when(F.col("unresolved") == "", baked))
               .drop("repl", "_missing", "_row", "_of"))


def preview(scripts: DataFrame, variables: DataFrame, biz_date: str | Column = "biz_date",
            hour: str | Column | None = "biz_hour", id_col: str = "script_id",
            text_col: str = "text", **bake_kw) -> DataFrame:
    """H14 then H13: the text a run would execute, from the same functions the
    run uses, so preview and run agree character for character.

    Baking is blocked by any unresolved placeholder.  Rendering is strict: a
    missing or invalid input wins (first in placeholder order), then any
    undeclared placeholder left in the baked text (a baked value may bring
    placeholders of its own; catalog ones are rendered).

    Returns (id, preview, error): ``preview`` is NULL exactly when ``error``
    is set.
    """
    baked = bake(scripts, variables, id_col=id_col, text_col=text_col, **bake_kw)
    r = render(F.col("baked"), biz_date, hour)
    error = (F.when(F.col("unresolved") != "", F.concat(F.lit(BAKE_BLOCKED), F.col("unresolved")))
              .when(F.col("_r.error").isNotNull(), F.col("_r.error"))
              .when(F.size("_r.unresolved") > 0,
                    F.concat(F.lit(UNDECLARED), failures(F.col("_r.unresolved")))))
    return (baked.select(id_col, "unresolved", r.alias("_r"))
                 .select(id_col, error.alias("error"), F.col("_r.text").alias("_text"))
                 .select(id_col, F.when(F.col("error").isNull(), F.col("_text")).alias("preview"), "error"))
