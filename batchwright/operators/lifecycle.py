"""Audits over task-instance metadata (B11, C7-C11, D5-D9, E3, E5, E6, H18,
H20, H22).

Inputs are plain DataFrames of instance events, runs, versions and logs.
Aggregations use map-side partial aggregation; ordered per-key work goes
through ``operators.sequence`` (large keys are cut into slots), and exact
percentiles are read off a per-(group, value) histogram, so no group's raw
values are ever collected in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwright.operators.asof import publish_history
from batchwright.operators.sequence import MAX_ROWS, forward_fill, previous_value, running_peak

# Legal instance state transitions ("start" = creation).
LEGAL_EDGES = [
    ("start", "pending"),
    ("pending", "waiting_dependency"),
    ("pending", "submitting"),
    ("waiting_dependency", "submitting"),
    ("waiting_dependency", "killed"),
    ("submitting", "submit_failed"),
    ("submitting", "running"),
    ("running", "succeeded"),
    ("running", "failed"),
    ("running", "killed"),
    ("submit_failed", "submitting"),
    ("failed", "submitting"),
]


def _legal(prev: Column, nxt: Column) -> Column:
    cond = F.lit(False)
    for a, b in LEGAL_EDGES:
        cond = cond | ((prev == a) & (nxt == b))
    return cond


# ---------------------------------------------------------------- B11
def instances(df: DataFrame, source: str | None = None, tenants: Sequence[str] | None = None,
              between: tuple[str, str] | None = None, app_id: str | None = None,
              ts: str = "created_at") -> DataFrame:
    """Filter instances by trigger source, tenant list, time range and
    application id; every predicate is a plain column filter that reaches the
    parquet scan."""
    out = df
    if source is not None:
        out = out.filter(F.col("trigger_source") == source)
    if tenants is not None:
        out = out.filter(F.col("tenant_id").isin(list(tenants)))
    if between is not None:
        out = out.filter(F.col(ts).between(F.lit(between[0]).cast("timestamp_ntz"),
                                           F.lit(between[1]).cast("timestamp_ntz")))
    if app_id is not None:
        out = out.filter(F.col("application_id") == app_id)
    return out


# ---------------------------------------------------------------- E3
def transitions(events: DataFrame, key: str = "instance_id", ts: str = "ts",
                tie: str = "event_id", state: str = "state", max_rows: int = MAX_ROWS) -> DataFrame:
    """Every (previous, next) state pair per instance with its legality;
    the first event of an instance is compared with ``start``."""
    with_prev = previous_value(events, [key], ts, tie, state, out="prev_state", max_rows=max_rows)
    prev = F.coalesce(F.col("prev_state"), F.lit("start"))
    return with_prev.withColumn("prev_state", prev).withColumn("legal", _legal(prev, F.col(state)))


def transition_counts(events: DataFrame, **kw) -> DataFrame:
    return (transitions(events, **kw).groupBy("prev_state", "state", "legal")
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- E5
def published_pointer(versions: DataFrame, rollbacks: DataFrame | None = None,
                      max_rows: int = MAX_ROWS) -> DataFrame:
    """E5: the published version of the task after each of its version events:
    (task_id, event_at, kind, version_id, pointer).

    Publishes and rollbacks (``asof.publish_history``) move the pointer; a
    version that was baked and never published is kind ``bake`` and leaves it.
    """
    moves = publish_history(versions, rollbacks).withColumn("_move", F.struct("version_id"))
    baked = versions.where(~F.coalesce(F.col("status").isin("published", "superseded", "rolled_back"), F.lit(False))).select(
        "task_id", F.col("baked_at").alias("moved_at"), F.lit("bake").alias("kind"), "version_id",
        F.struct(F.lit(0).alias("rank"), F.col("version_id").cast("long").alias("id")).alias("move_seq"))
    events = moves.unionByName(baked, allowMissingColumns=True)
    return forward_fill(events, ["task_id"], "moved_at", "move_seq", "_move", out="_pointer", max_rows=max_rows).select(
        "task_id", F.col("moved_at").alias("event_at"), "kind", "version_id",
        F.col("_pointer.version_id").alias("pointer"))


# ---------------------------------------------------------------- E6
def peak_running(runs: DataFrame, by: str = "tenant_id", start: str = "started_at",
                 end: str = "ended_at", tie: str = "event_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """Peak number of concurrently running instances per group; a run
    without an end keeps running."""
    starts = runs.select(by, F.col(start).alias("_t"), F.lit(1).alias("_d"), tie)
    ends = runs.filter(F.col(end).isNotNull()).select(by, F.col(end).alias("_t"), F.lit(-1).alias("_d"), tie)
    return running_peak(starts.unionByName(ends), [by], "_t", "_d", tie, max_rows=max_rows)


# ---------------------------------------------------------------- C7
def ready(instances_df: DataFrame, deps: DataFrame, task: str = "task_id", day: str = "biz_date",
          ok: str = "ok", order: Sequence[str] = ()) -> DataFrame:
    """An instance (task, day) is ready when every upstream instance
    (upstream, day - offset) exists and succeeded; a missing, failed or
    cancelled upstream keeps it waiting.  ``deps``: (task_id, upstream_id,
    offset); a dependency listed twice counts once.

    Attempts are reduced to one outcome per (task, day) first: the last
    attempt's under ``order``, or without one whether any attempt succeeded.
    """
    outcome = F.coalesce(F.max_by(ok, F.struct(*order)) if order else F.bool_or(ok), F.lit(False))
    final = instances_df.groupBy(task, day).agg(outcome.alias(ok))
    status = final.select(F.col(task).alias("upstream_id"), F.col(day).alias("_uday"), F.col(ok).alias("_uok"))
    need = (final.select(task, day).join(deps.select(task, "upstream_id", "offset").distinct(), task, "left")
            .withColumn("_uday", F.date_sub(F.col(day), F.col("offset"))))
    checked = need.join(status, ["upstream_id", "_uday"], "left")
    return (checked.groupBy(task, day)
            .agg(F.count("upstream_id").alias("n_deps"),
                 F.coalesce(F.bool_and(F.when(F.col("upstream_id").isNotNull(),
                                              F.coalesce(F.col("_uok"), F.lit(False)))),
                            F.lit(True)).alias("ready"))
            .withColumn("state", F.when(F.col("ready"), F.lit("submitting"))
                        .otherwise(F.lit("waiting_dependency"))))


# ---------------------------------------------------------------- C8, C9
def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once: only in ``a`` (unsynced), only in ``b`` (orphan), or in
    both, with its number of rows on either side.  A NULL key is a key.  One
    partial aggregation over both sides, so a hot key is a few rows per task."""
    keys = list(keys)
    rows = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return (rows.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
            .select(*keys, F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.lit("both"))
                    .when(F.col("n_a") > 0, F.lit("unsynced")).otherwise(F.lit("orphan")).alias("status"),
                    "n_a", "n_b"))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Each key once: ``same``, ``changed`` (with the changed columns,
    sorted), ``only_old`` or ``only_new``, and its number of rows on either
    side; NULL equals NULL, in keys too.

    For a key with one row per side, columns are compared by value.  For a
    repeated key, a column is the same when both sides hold the same values the
    same number of times (by minimum, maximum, number of NULLs and a sum of
    hashes); differing numbers of rows are a change of the column ``*``.  One
    partial aggregation over both sides: repeated keys never multiply.
    """
    keys = list(keys)

    def side(df: DataFrame, old: bool) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"_v_{c}") for c in cols], F.lit(old).alias("_old"))

    aggs = [F.count(F.when(F.col("_old"), 1)).alias("n_old"), F.count(F.when(~F.col("_old"), 1)).alias("n_new")]
    for c in cols:
        for old in (True, False):
            v = F.when(F.col("_old") == old, F.col(f"_v_{c}"))
            mine = F.when(F.col("_old") == old, F.xxhash64(f"_v_{c}").cast("decimal(38,0)"))
            aggs.append(F.struct(F.min(v), F.max(v), F.count(v), F.sum(mine)).alias(f"_{old}_{c}"))
    g = side(a, True).unionByName(side(b, False)).groupBy(*keys).agg(*aggs)
    n_differ = F.when(F.col("n_old") != F.col("n_new"), F.lit("*"))
    differ = [F.when(~F.col(f"_True_{c}").eqNullSafe(F.col(f"_False_{c}")), F.lit(c)) for c in cols]
    diffs = F.array_sort(F.array_compact(F.array(n_differ, *differ)))
    status = (F.when(F.col("n_old") == 0, F.lit("only_new"))
               .when(F.col("n_new") == 0, F.lit("only_old"))
               .when(F.size(diffs) > 0, F.lit("changed")).otherwise(F.lit("same")))
    return g.select(*keys, status.alias("status"),
                    F.when(status == "changed", F.array_join(diffs, ",")).otherwise(F.lit("")).alias("changed_cols"),
                    "n_old", "n_new")


# ---------------------------------------------------------------- C10, C11
def lineage(inst: DataFrame, versions: DataFrame, drafts: DataFrame, tasks: DataFrame,
            projects: DataFrame) -> DataFrame:
    """Instance -> version -> draft revision -> task -> project, left
    joins throughout so a broken link shows as NULL instead of a lost row.
    ``versions``: (version_id, draft_revision_id); ``drafts``:
    (draft_revision_id, task_id, author); ``tasks``: (task_id, project_id);
    ``projects``: (project_id, ...)."""
    return (inst.join(versions, "version_id", "left")
                .join(drafts, "draft_revision_id", "left")
                .join(tasks, "task_id", "left")
                .join(projects, "project_id", "left"))


def trace(layers: Sequence[DataFrame], trace_id: str | None = None) -> DataFrame:
    """C11: rows of all layers (trace_id, ts, layer, detail) in time order per
    trace.  The final sort range-partitions on (trace_id, ts), so one huge
    trace is split by time across tasks."""
    rows = layers[0]
    for other in layers[1:]:
        rows = rows.unionByName(other)
    if trace_id is not None:
        rows = rows.filter(F.col("trace_id") == trace_id)
    return rows.orderBy("trace_id", "ts", "layer", "detail")


# ---------------------------------------------------------------- D5-D8
def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float],
                      names: Sequence[str], counts: dict[str, Column] | None = None, ranges: int = 64) -> DataFrame:
    """Nearest-rank percentiles (smallest v with count(x <= v) >= ceil(p * n)),
    plus ``counts``: {name: condition} counted per group (NULL values count).

    Works on the histogram (group, value) -> counts, partial-aggregated, in two
    steps: a group's values are cut into ``ranges`` equal stretches of its span;
    a stretch's total, and the totals before it, tell which stretches hold a
    wanted rank; only those are cumulated, each on its own, from that offset.
    So no task sees more than one stretch of a group's histogram, and the
    window over a group has ``ranges`` rows.  ``value`` is a whole number."""
    by = list(by)
    counts = dict(counts or {})
    v = F.col(value)
    hist = df.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.count(F.when(cond, 1)).alias(f"_x{i}") for i, cond in enumerate(counts.values())])
    keyed = [F.col(c).alias(f"_k{j}") for j, c in enumerate(by)]
    same = F.lit(True)
    for j, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{j}"))
    keys = [f"_k{j}" for j in range(len(by))]
    span = hist.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).select(*keyed, "_lo", "_hi")
    # NULL values have no rank; they only count
    at = F.floor((v - F.col("_lo")) / ((F.col("_hi") - F.col("_lo") + 1) / F.lit(ranges)))
    cut = hist.join(span, same).withColumn("_r", F.coalesce(at, F.lit(-1))).drop("_lo", "_hi", *keys)
    group = Window.partitionBy(*by)
    totals = (cut.groupBy(*by, "_r")
              .agg(F.sum(F.when(v.isNotNull(), F.col("_c")).otherwise(0)).alias("_total"),
                   *[F.sum(f"_x{i}").alias(f"_x{i}") for i in range(len(counts))])
              .withColumn("_n", F.sum("_total").over(group))
              .withColumn("_before", F.sum("_total").over(
                  group.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_total")))
    ranks = {nm: F.ceil(F.col("_n") * F.lit(p)) for p, nm in zip(ps, names)}
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | ((rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_total")))
    offsets = totals.where(wanted).select(*keyed, F.col("_r").alias("_kr"), "_before", "_n")
    inside = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (cut.join(offsets, same & (F.col("_r") == F.col("_kr")))
             .withColumn("_cum", F.col("_before") + F.sum("_c").over(inside))
             .groupBy(*by).agg(*[F.min(F.when(F.col("_cum") >= rank, v)).alias(nm) for nm, rank in ranks.items()])
             .withColumnsRenamed({c: f"_k{j}" for j, c in enumerate(by)}))
    return (totals.groupBy(*by).agg(*[F.sum(f"_x{i}").alias(name) for i, name in enumerate(counts)])
            .join(found, same, "left").drop(*keys))


def run_metrics(runs: DataFrame, by: str = "tenant_id", duration: str = "duration_s") -> DataFrame:
    """Runs, successes, success rate and exact P50/P95/P99 of duration."""
    out = exact_percentiles(runs, [by], duration, [0.5, 0.95, 0.99], ["p50_s", "p95_s", "p99_s"],
                            counts={"n_runs": F.lit(True), "n_succeeded": F.col("state") == "succeeded"})
    return out.select(by, "n_runs", "n_succeeded", (F.col("n_succeeded") / F.col("n_runs")).alias("success_rate"),
                      "p50_s", "p95_s", "p99_s")


def publish_metrics(pubs: DataFrame, by: str = "project_id", duration: str = "duration_ms",
                    outcome: str = "outcome") -> DataFrame:
    """Publish requests, published ones, publish success rate and exact
    P50/P95/P99 of publish time per group."""
    out = exact_percentiles(pubs, [by], duration, [0.5, 0.95, 0.99], ["p50_ms", "p95_ms", "p99_ms"],
                            counts={"n_publishes": F.lit(True), "n_published": F.col(outcome) == "published"})
    return out.select(by, "n_publishes", "n_published",
                      (F.col("n_published") / F.col("n_publishes")).alias("success_rate"),
                      "p50_ms", "p95_ms", "p99_ms")


def adapter_metrics(calls: DataFrame, by: str = "operation", outcome: str = "outcome") -> DataFrame:
    """Scheduler-adapter calls, failed ones and the error rate per group
    (target: below 0.5 %); a call without an outcome has failed."""
    failed = ~F.coalesce(F.col(outcome) == "ok", F.lit(False))
    return (calls.groupBy(by).agg(F.count(F.lit(1)).alias("n_calls"), F.count(F.when(failed, 1)).alias("n_errors"))
            .withColumn("error_rate", F.col("n_errors") / F.col("n_calls")))


def duration_histogram(runs: DataFrame, by: str = "tenant_id", duration: str = "duration_s",
                       lo: float = 0.0, hi: float = 3600.0, buckets: int = 12) -> DataFrame:
    """Count of runs per duration bucket (``width_bucket``)."""
    b = F.expr(f"width_bucket({duration}, {lo}, {hi}, {buckets})")
    return runs.groupBy(by, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n_runs"))


def retry_stats(events: DataFrame, key: str = "instance_id", limit: int = 2, ts: str = "ts",
                tie: str = "event_id") -> DataFrame:
    """Attempts (submits), retries, whether the retry budget is exhausted
    without success, and whether the first failure was followed by a success."""
    s = F.col("state")
    when = F.struct(ts, tie)
    return (events.groupBy(key)
            .agg(F.count(F.when(s == "submitting", 1)).alias("n_attempts"),
                 F.count(F.when(s.isin("failed", "submit_failed"), 1)).alias("n_failures"),
                 F.coalesce(F.bool_or(s == "succeeded"), F.lit(False)).alias("succeeded"),
                 F.min(F.when(s.isin("failed", "submit_failed"), when)).alias("_failed"),
                 F.max(F.when(s == "succeeded", when)).alias("_succeeded"))
            .withColumn("retries", F.greatest(F.col("n_attempts") - 1, F.lit(0)))
            .withColumn("exhausted", (F.col("retries") >= limit) & ~F.col("succeeded"))
            .withColumn("recovered", F.coalesce(F.col("_failed") < F.col("_succeeded"), F.lit(False)))
            .drop("_failed", "_succeeded"))


def retry_summary(stats: DataFrame, by: str | None = None) -> DataFrame:
    """Over ``retry_stats`` rows: instances with a failure, how many of
    them later succeeded (retry success rate, target > 30 %) and how many
    exhausted their retry budget."""
    aggs = [F.count(F.when(F.col("n_failures") > 0, 1)).alias("n_failed"),
            F.count(F.when(F.col("recovered"), 1)).alias("n_recovered"),
            F.count(F.when(F.col("exhausted"), 1)).alias("n_exhausted")]
    g = stats.groupBy(by).agg(*aggs) if by else stats.agg(*aggs)
    return g.withColumn("retry_success_rate",
                        F.when(F.col("n_failed") > 0, F.col("n_recovered") / F.col("n_failed")))


def coverage(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Share of rows where ``col`` is present."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count(col).alias("n_present")]
    g = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumn("coverage", F.col("n_present") / F.col("n_rows"))


def instance_coverage(logs: DataFrame, key: str = "instance_id", col: str = "trace_id",
                      by: str | None = None) -> DataFrame:
    """Share of instances with ``col`` present in any of their rows (target
    100 %).  One row per instance first, by partial aggregation."""
    one = logs.groupBy(*([by] if by else []), key).agg(F.max(col).alias(col))
    return coverage(one, col, by).withColumnsRenamed({"n_rows": "n_instances"})


def daily_counts(df: DataFrame, by: str = "tenant_id", ts: str = "ts",
                 key: str = "instance_id") -> DataFrame:
    """Distinct instances per group and day."""
    return (df.groupBy(by, F.to_date(ts).alias("day"))
              .agg(F.countDistinct(key).alias("n_instances"), F.count(F.lit(1)).alias("n_events")))


# ---------------------------------------------------------------- H20, H22
def sla_breaches(runs: DataFrame, limit_s: int, as_of: str, start: str = "started_at",
                 end: str = "ended_at") -> DataFrame:
    """Runs longer than ``limit_s``; a run without an end counts up to ``as_of``."""
    stop = F.coalesce(F.col(end), F.lit(as_of).cast("timestamp_ntz"))
    secs = (F.unix_micros(stop.cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1_000_000
    return (runs.withColumn("run_s", secs.cast("long"))
                .withColumn("still_running", F.col(end).isNull())
                .filter(F.col("run_s") > limit_s))


def audit_diff(df: DataFrame, before: str = "before_json", after: str = "after_json",
               key: str = "id") -> DataFrame:
    """One row per changed, added or removed top-level JSON key.

    Presence decides: a key that turns from a value to JSON null, or back, has
    ``changed``, and an added key may hold null.  A NULL text is a record that
    does not exist, with no keys.  A text that is no JSON object gives one row
    ``malformed`` (field NULL, both texts as they are) instead of a comparison.
    """
    kind = "map<string,string>"
    m1, m2 = F.from_json(F.col(before), kind), F.from_json(F.col(after), kind)
    rows = df.select(key, F.col(before).alias("_t1"), F.col(after).alias("_t2"), m1.alias("_m1"), m2.alias("_m2"))
    bad = (F.col("_t1").isNotNull() & F.col("_m1").isNull()) | (F.col("_t2").isNotNull() & F.col("_m2").isNull())
    none = F.create_map().cast(kind)
    m1, m2 = F.coalesce("_m1", none), F.coalesce("_m2", none)
    parts = F.transform(F.array_union(F.map_keys(m1), F.map_keys(m2)), lambda k: F.struct(
        k.alias("field"), F.map_contains_key(m1, k).alias("had"), F.map_contains_key(m2, k).alias("has"),
        F.try_element_at(m1, k).alias("before"), F.try_element_at(m2, k).alias("after")))
    change = (F.when(~F.col("v.had"), F.lit("added")).when(~F.col("v.has"), F.lit("removed"))
              .when(~F.col("v.before").eqNullSafe(F.col("v.after")), F.lit("changed")))
    compared = (rows.where(~bad).select(key, F.explode(parts).alias("v"))
                .select(key, "v.field", "v.before", "v.after", change.alias("change")).where("change is not null"))
    return compared.unionByName(rows.where(bad).select(
        key, F.lit(None).cast("string").alias("field"), F.col("_t1").alias("before"), F.col("_t2").alias("after"),
        F.lit("malformed").alias("change")))


def trigger_latency(triggers: DataFrame, by: str = "tenant_id", scheduled: str = "scheduled_at",
                    created: str = "created_at") -> DataFrame:
    """Trigger latency (created - scheduled, whole seconds): count and
    exact P50/P95/P99 per group."""
    lat = ((F.unix_micros(F.col(created).cast("timestamp"))
            - F.unix_micros(F.col(scheduled).cast("timestamp"))) / 1_000_000).cast("long")
    return exact_percentiles(triggers.withColumn("latency_s", lat), [by], "latency_s", [0.5, 0.95, 0.99],
                             ["p50_s", "p95_s", "p99_s"], counts={"n_triggers": F.lit(True)})
