"""Replay of instance events where a rejected transition changes nothing.

An event asks for a state.  It is granted if the move from the instance's *true*
state is legal; otherwise it is rejected and the true state stays, so the next
event is judged against the state before the rejected one.  A window cannot say
this: each verdict depends on all verdicts before it.

The replay is a scan over functions.  An event is a map from state to state, and
maps compose.  Events of a key are numbered and grouped by ``FAN``; a group's
events compose to one map, groups of maps compose again, until one map per slot
and then per key is left.  Back down, every group gets the state it starts in,
and its events are replayed from there.  So a key of any length is replayed by
groups of bounded size, in a number of steps that grows with the logarithm of
its length; keys of at most ``FAN`` events, the usual case, need one shuffle and
no maps at all.  Keys above ``max_rows`` are numbered slot by slot.  Events must
not hold map columns, which do not sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwright.operators.sequence import MAX_ROWS, _written, slotted

FAN = 256


def _numbers(edges: Sequence[tuple[str, str]], start: str) -> list[str]:
    names = [start]
    for pair in edges:
        names += [s for s in pair if s not in names]
    return names


def _granted(edges: Sequence[tuple[str, str]], names: list[str], state: Column, asked: Column) -> Column:
    """Whether a move is legal; NULL if the state asked for is in no edge."""
    legal = set(edges)
    return F.get(F.array(*[F.lit((a, b) in legal) for a in names for b in names]), state * len(names) + asked)


def _step(edges: Sequence[tuple[str, str]], names: list[str]):
    """(state, asked) -> next state, as numbers."""
    return lambda state, asked: F.when(_granted(edges, names, state, asked), asked).otherwise(state)


def _composed(maps: Column, n: int) -> Column:
    """The maps of an array of (place, map), in order, as one map."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.aggregate(
        maps, s.cast("int"), lambda at, x: F.get(x["map"], at)))


def _running(values: Column, first: Column, step) -> Column:
    """Per value: (state before it, state after it), in order."""
    kind = "array<struct<before:int,after:int>>"
    return F.aggregate(
        values, F.struct(first.alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(step(a["at"], x).alias("at"), F.array_append(
            a["out"], F.struct(a["at"].alias("before"), step(a["at"], x).alias("after"))).alias("out")),
        lambda a: a["out"])


def _starts(groups: DataFrame, by: list[str], place: str, n: int, fan: int) -> DataFrame:
    """(by, place, start): the state in which each group of a key starts.
    ``groups``: (by, place from 0 on, map)."""
    levels = [groups]
    while True:
        top = levels[-1].agg(F.max(place)).first()[0]
        if not top:
            break
        up = levels[-1].groupBy(*by, F.expr(f"{place} div {fan}").alias("_up")).agg(
            F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), "map"))).alias("_maps"))
        levels.append(_written(up.select(*by, F.col("_up").alias(place), _composed(F.col("_maps"), n).alias("map")),
                               "replay-maps"))
    known = levels[-1].select(*by, place, F.lit(0).alias("start"))
    for low in reversed(levels[:-1]):
        parts = low.groupBy(*by, F.expr(f"{place} div {fan}").alias("_up")).agg(
            F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), "map"))).alias("_maps"))
        same = F.col("_up") == F.col(f"_{place}")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        above = known.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(place).alias(f"_{place}"), "start")
        known = parts.join(above, same).select(*by, F.explode(F.arrays_zip(
            "_maps", _running(F.col("_maps"), F.col("start"), lambda s, x: F.get(x["map"], s)).alias("_r"))).alias("g")) \
            .select(*by, F.col("g._maps.at").alias(place), F.col("g._r.before").alias("start"))
    return known


def replay(events: DataFrame, edges: Sequence[tuple[str, str]], key: str = "instance_id", ts: str = "ts",
           tie: str = "event_id", state: str = "state", start: str = "start", max_rows: int = MAX_ROWS,
           fan: int = FAN) -> DataFrame:
    """Every event with ``from_state``, the true state it meets, whether it is
    ``legal``, and ``true_state`` after it.

    Events are taken in (ts, tie) order, NULL times first; ``tie`` tells events
    of one instant apart.  A NULL key is a key.  A state that is NULL or in no
    edge is never legal.
    """
    names = _numbers(edges, start)
    n, step = len(names), _step(edges, names)
    columns = events.columns
    asked = F.lit(None).cast("int")
    for i, name in enumerate(names):
        asked = F.when(F.col(state) == name, F.lit(i)).otherwise(asked)
    longest = events.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    [b], cut = slotted([events], [key], [ts, tie], max_rows)
    number = F.row_number().over(Window.partitionBy(key, "_b").orderBy(ts, tie)) - 1
    # one shuffle: a key's groups lie where the window has put the key
    groups = b.withColumn("_n", number).groupBy(F.col(key).alias("_key"), "_b", F.expr(f"_n div {fan}").alias("_g")).agg(
        F.sort_array(F.collect_list(F.struct("_n", asked.alias("asked"), F.struct(*columns).alias("row")))).alias("_events"))
    asks = F.transform("_events", lambda x: x["asked"])
    if longest <= fan:
        ready = groups.withColumn("start", F.lit(0))
    else:
        if cut:  # number the groups of a key through its slots
            groups = _written(groups, "replay")
            slots = groups.groupBy("_key", "_b").agg((F.max("_g") + 1).alias("_groups"))
            before = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            slots = slots.select(F.col("_key").alias("_k"), F.col("_b").alias("_slot"),
                                 F.coalesce(F.sum("_groups").over(before), F.lit(0)).alias("_before"))
            groups = groups.join(slots, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_slot"))) \
                .withColumn("_g", F.col("_g") + F.col("_before")).drop("_k", "_slot", "_before")
        groups = _written(groups, "replay")
        own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.aggregate(asks, s.cast("int"), step))
        maps = _written(groups.select("_key", "_g", own.alias("map")), "replay-maps")
        starts = _starts(maps, ["_key"], "_g", n, fan).select(F.col("_key").alias("_k"), F.col("_g").alias("_place"), "start")
        ready = groups.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_g") == F.col("_place")))
    label = F.array(*[F.lit(x) for x in names])
    e = F.col("z._events.row")
    return ready.withColumn("_r", _running(asks, F.col("start"), step)) \
        .select(F.explode(F.arrays_zip("_events", "_r")).alias("z")).select(
            *[e[c].alias(c) for c in columns], F.get(label, F.col("z._r.before")).alias("from_state"),
            F.coalesce(_granted(edges, names, F.col("z._r.before"), F.col("z._events.asked")), F.lit(False)).alias("legal"),
            F.get(label, F.col("z._r.after")).alias("true_state"))


def true_states(replayed: DataFrame, key: str = "instance_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Per key the true state after all events, and how many events were rejected."""
    return replayed.groupBy(key).agg(
        F.max_by("true_state", F.struct(ts, tie)).alias("true_state"), F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(~F.col("legal"), 1)).alias("n_rejected"))
