"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once: that
speaker's turns as ``assistant``, everybody else's as ``user`` with a name,
system turns as ``system`` for all.  ``spans`` are the code-point offsets of
what the assistant writes (its text and end mark, not its header): the loss
mask of that rendering.

A conversation of at most ``limit`` rows is gathered and rendered whole, with
one shuffle of the texts, whatever its turns are numbered.  A larger one is
rendered in parts, cut where the running number of its rows, in the order of
turns, passes a multiple of ``limit``.  The running number is summed in ranges of
(conversation, turn), so no task holds more of a conversation than a part,
whatever share of the table it has.  Parts in the order of ``part`` and
``part_slice`` make up the dialogue, and offsets count from the part's beginning;
a whole dialogue is part 0, slice 0.

A null turn comes first; equal turns are ordered by speaker and then text (in a
turn number of more than ``limit`` rows, by slices of a hash before that).
Rows that repeat conversation, turn, speaker and text are one turn.  A null
speaker is ``unknown``, a null text empty.  A row without a conversation id is
a dialogue of its own.  Conversations of system turns alone have no
participant, and give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchwright.llm.common import stored, table

LIMIT = 1024
NO_TURN = -(1 << 62)  # sorts a null turn first

HEAD = """concat('<|im_start|>', case when t.role = 'system' then 'system' when t.role = speaker then 'assistant'
  else concat('user name=', regexp_replace(t.role, '[\\\\s<>|]+', '_')) end, '\n')"""
TAIL = "<|im_end|>\n"


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, lone, t, role, text), free of nulls but in conv_id."""
    return df.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_TURN)).alias("t"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.replace(F.col(text_col), F.lit("<|im_"), F.lit("< |im_")), F.lit("")).alias("text"),
    ).withColumn("lone", F.when(F.col("conv_id").isNull(), F.xxhash64("t", "role", "text")).otherwise(F.lit(0)))


def gathered(rows: DataFrame, *part: str) -> DataFrame:
    """One row per conversation and part with its turns in order, once each."""
    return rows.groupBy("conv_id", "lone", *part).agg(
        F.sort_array(F.collect_set(F.struct("t", "role", "text"))).alias("turns"))


def render(parts: DataFrame) -> DataFrame:
    """From (conv_id, speaker, part, part_slice, turns)."""
    seg = F.expr(f"transform(turns, t -> named_struct('own', t.role = speaker, 'head', {HEAD}, 'text', t.text))")
    spans = F.expr(f"""aggregate(segs, named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,end:bigint>>)),
      (a, x) -> named_struct(
        'at', a.at + char_length(x.head) + char_length(x.text) + {len(TAIL)}L,
        'out', if(x.own, array_append(a.out, named_struct('start', a.at + char_length(x.head),
          'end', a.at + char_length(x.head) + char_length(x.text) + {len(TAIL) - 1}L)), a.out)),
      a -> a.out)""")
    text = F.expr(f"array_join(transform(segs, x -> concat(x.head, x.text, '{TAIL}')), '')")
    return parts.withColumn("segs", seg).select(
        "conv_id", "speaker", "part", "part_slice", F.size("turns").cast("long").alias("n_turns"),
        text.alias("text"), spans.alias("spans"))


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(conv_id, speaker, part, part_slice, n_turns, text, spans)."""
    rows = turns_of(df, conv_col, turn_col, role_col, text_col)
    large = stored(rows.where("conv_id is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") > limit).select("conv_id"), "chat-large")
    some = not large.isEmpty()
    small = rows.join(large, "conv_id", "left_anti") if some else rows
    whole = gathered(small).withColumn("part", F.lit(0).cast("long")).withColumn("part_slice", F.lit(0).cast("long")) \
        .withColumn("speaker", F.explode(F.expr("array_distinct(transform(turns, t -> t.role))"))) \
        .where("speaker <> 'system'")
    out = render(whole)
    if some:
        out = out.unionByName(render(in_parts(rows.join(large, "conv_id", "left_semi").dropDuplicates(), limit)))
    return out


def in_parts(rows: DataFrame, limit: int) -> DataFrame:
    by_turn = rows.groupBy("conv_id", "t").agg(F.count(F.lit(1)).alias("n"))
    # ranges of (conversation, turn), kept with the rows, so that sums go range by range
    ranged = stored(by_turn.repartitionByRange("conv_id", "t").withColumn("range", F.spark_partition_id()), "chat-turns")
    so_far = (Window.unboundedPreceding, -1)
    earlier = ranged.groupBy("conv_id", "range").agg(F.sum("n").alias("of_range")).withColumn(
        "earlier", F.coalesce(F.sum("of_range").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(*so_far)), F.lit(0)))
    before = F.col("earlier") + F.coalesce(
        F.sum("n").over(Window.partitionBy("conv_id", "range").orderBy("t").rowsBetween(*so_far)), F.lit(0))
    big = F.col("n") > limit
    # a turn of too many rows is a part of its own, after the turns before it, and cut by its hash
    parts = ranged.join(earlier.select("conv_id", "range", "earlier"), ["conv_id", "range"]).withColumn("before", before) \
        .select("conv_id", "t", F.when(big, F.ceil(F.lit(2) * F.col("n") / limit)).otherwise(F.lit(1)).alias("slices"),
                (F.expr(f"2 * (before div {limit})") + big.cast("long")).alias("part"))
    cut = rows.join(parts, ["conv_id", "t"]).withColumn("part_slice", F.floor(
        F.pmod(F.xxhash64("role", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("slices")).cast("long"))
    speakers = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    return gathered(cut, "part", "part_slice").join(speakers, "conv_id")


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations")).withColumn(
        "spans", F.expr("array_join(transform(spans, x -> concat_ws(':', x.start, x.end)), ',')"))


#: No conversation of the tables has more than LIMIT rows, so the SQL renders whole dialogues only.
ORACLES = {"op4_chat_rotation": """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role,
    coalesce(replace(text, '<|im_', '< |im_'), '') AS text
  FROM conversations
), seg AS (
  SELECT t.*, s.speaker, t.role = s.speaker AS own, '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system'
    WHEN t.role = s.speaker THEN 'assistant' ELSE 'user name=' || regexp_replace(t.role, '[\\s<>|]+', '_', 'g') END || chr(10) AS head
  FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system') s USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, speaker
    ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM seg
)
SELECT conv_id, speaker, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS part_slice, count(*) AS n_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(CAST(CAST(begun AS BIGINT) + length(head) AS VARCHAR) || ':'
    || CAST(CAST(begun AS BIGINT) + length(head) + length(text) + 10 AS VARCHAR), ','
    ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY conv_id, speaker
"""}
