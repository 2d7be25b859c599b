"""Column helpers used by the dimension job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_key(*cols: str) -> Column:
    """B2: every key present, i.e. not NULL and not the empty string."""
    cond = None
    for c in cols:
        one = F.col(c).isNotNull() & (F.col(c) != F.lit(""))
        cond = one if cond is None else cond & one
    return cond


def null_as(type_name: str) -> Column:
    """A typed NULL column, e.g. ``null_as('string')``."""
    return F.lit(None).cast(type_name)


def change_flag(is_del: str | Column, insert_time: str | Column, update_time: str | Column) -> Column:
    """B9/H2: '-1' when deleted, '1' when inserted and updated on the same day,
    otherwise '0' (NULL dates fall through to '0')."""
    d = F.col(is_del) if isinstance(is_del, str) else is_del
    ins = F.col(insert_time) if isinstance(insert_time, str) else insert_time
    upd = F.col(update_time) if isinstance(update_time, str) else update_time
    return (F.when(d == F.lit("1"), F.lit("-1"))
            .when(F.to_date(ins) == F.to_date(upd), F.lit("1"))
            .otherwise(F.lit("0")))


def load_stamp(as_of: str | None) -> Column:
    """H3: the load time as a string.  Pass ``as_of`` to pin it (tests, reruns);
    ``None`` falls back to ``current_timestamp()``."""
    if as_of is None:
        return F.current_timestamp().cast("string")
    return F.lit(as_of).cast("timestamp").cast("string")
