"""Audit records compared path by path (H22), on Spark's VARIANT values.

Each text is parsed once.  A value is flattened to its leaves, (path, type,
value): one round opens one level of objects and arrays within each row, rows
without open values leave, and each round is written below the checkpoint
folder; rounds are as many as the deepest text has levels.  Old and new leaves
then meet by row and path, so a record with many leaves is spread over tasks.

A path is ``$``, then ``.key`` or ``[place]`` for each step; a key with anything
but letters, digits and ``_`` stands in double quotes.  An empty object or
array is a leaf.  Key order means nothing, and numbers are equal by value: ``1``,
``1.0`` and ``1e0`` are one number.  A type that changes is a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.operators.sequence import _written

STEP = r"""if(e.key rlike '^[A-Za-z0-9_]+$', concat('.', e.key),
  concat('."', replace(replace(e.key, '\\', '\\\\'), '"', '\\"'), '"'))"""
KIND = "substring_index(substring_index(schema_of_variant(x.v), '<', 1), '(', 1)"
OPEN = f"({KIND} in ('OBJECT', 'ARRAY') and to_json(x.v) not in ('{{}}', '[]'))"
OPENED = f"""flatten(transform(leaves, x -> if(not {OPEN}, array(x), if({KIND} = 'OBJECT',
  transform(map_entries(try_variant_get(x.v, '$', 'map<string,variant>')),
    e -> named_struct('path', concat(x.path, {STEP}), 'v', e.value)),
  transform(try_variant_get(x.v, '$', 'array<variant>'),
    (y, i) -> named_struct('path', concat(x.path, '[', i, ']'), 'v', y))))))"""


def _leaves(sides: DataFrame) -> DataFrame:
    """(row, old, path, v) of all leaves; ``sides``: (row, old, v)."""
    level = sides.select("row", "old", F.expr("array(named_struct('path', '$', 'v', v))").alias("leaves"))
    done = []
    while True:
        level = _written(level.withColumn("open", F.expr(f"exists(leaves, x -> {OPEN})")), "audit-level")
        done.append(level.where("not open").select("row", "old", F.expr("inline(leaves)")))
        if level.where("open").isEmpty():
            break
        level = level.where("open").select("row", "old", F.expr(OPENED).alias("leaves"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _typed(leaves: DataFrame) -> DataFrame:
    """The leaves with type and value; ``rounded`` numbers have an exponent in the text and compare as doubles."""
    kind = KIND.replace("x.v", "v")
    double = "try_variant_get(v, '$', 'double')"
    whole = f"{double} = floor({double}) and abs({double}) < 9007199254740992"
    return leaves.select(
        "row", "old", "path",
        F.expr(f"""case when {kind} in ('BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT') then 'number' when {kind} = 'VOID' then 'null'
          else lower({kind}) end""").alias("type"),
        F.expr(f"""case when {kind} = 'VOID' then 'null' when {kind} in ('OBJECT', 'ARRAY') then to_json(v)
          when {kind} = 'DOUBLE' and {whole} then cast(cast({double} as bigint) as string)
          else try_variant_get(v, '$', 'string') end""").alias("value"),
        F.expr(f"{kind} = 'DOUBLE'").alias("rounded"), F.expr(f"if({kind} in ('BIGINT', 'DECIMAL', 'DOUBLE'), {double}, null)").alias("number"))


def audit_paths(df: DataFrame, before: str = "before_json", after: str = "after_json", key: str = "id") -> DataFrame:
    """(key, path, change, old_type, before, new_type, after): one row per leaf
    that was ``added``, ``removed`` or ``changed``.

    A NULL text is a record that does not exist: all leaves of the other side
    are added or removed.  A text that is no JSON, or an object with a repeated
    key, gives one row ``malformed`` (path NULL, both texts as they are).  Rows
    are compared each by itself, whether their key is NULL or repeated.
    """
    rows = _written(df.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), F.col(before).alias("t1"), F.col(after).alias("t2"),
        F.try_parse_json(before).alias("v1"), F.try_parse_json(after).alias("v2")), "audit-rows")
    bad = (F.col("t1").isNotNull() & F.col("v1").isNull()) | (F.col("t2").isNotNull() & F.col("v2").isNull())
    good = rows.where(~bad)
    sides = good.select("row", F.expr("inline(array(named_struct('old', true, 'v', v1), named_struct('old', false, 'v', v2)))")) \
        .where("v is not null")
    leaves = _typed(_leaves(sides))
    side = lambda old, n: leaves.where(F.col("old") == old).select(
        "row", "path", *[F.col(c).alias(f"{c}{n}") for c in ("type", "value", "rounded", "number")])
    both = side(True, 1).join(side(False, 2), ["row", "path"], "full")
    equal = F.expr("type1 = type2 and if(type1 = 'number' and (rounded1 or rounded2), number1 = number2, value1 = value2)")
    change = F.when(F.col("type1").isNull(), "added").when(F.col("type2").isNull(), "removed").when(~equal, "changed")
    found = both.withColumn("change", change).where("change is not null").join(rows.select("row", "_key"), "row").select(
        F.col("_key").alias(key), "path", "change", F.col("type1").alias("old_type"), F.col("value1").alias("before"),
        F.col("type2").alias("new_type"), F.col("value2").alias("after"))
    none = F.lit(None).cast("string")
    return found.unionByName(rows.where(bad).select(
        F.col("_key").alias(key), none.alias("path"), F.lit("malformed").alias("change"), none.alias("old_type"),
        F.col("t1").alias("before"), none.alias("new_type"), F.col("t2").alias("after")))
