"""Multi-party perspective rotation: a dialogue rendered once for each participant, with that speaker as assistant.

The rendering is kept as one row per turn, so that a dialogue of any length is spread over tasks; texts in turn order, one after the other,
are the rendered dialogue. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from changelake.llm.common import stored

#: Speakers that set the scene: they keep their role and are nobody's perspective.
NARRATORS = ("system",)


def _segment(role: Column, name: Column, text: Column) -> Column:
    head = F.concat(F.lit("<|"), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(""), F.lit("|>\n"))
    return F.concat(head, text, F.lit("<|end|>\n"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every dialogue from the perspective of every participant.

    Returns one row per dialogue, perspective and turn: conv_id, perspective, turn, position (from 0), role ('assistant' for the
    perspective's own turns, 'user' for other participants, 'system' for narrators), name (of other participants), segment (the rendered
    turn), start and stop (code points of the segment in the whole rendering), loss_start and loss_stop (the part that is trained
    on: the assistant's words and the end mark; null for all other turns).

    Turns are ordered by turn, speaker and text; equal rows are turns of their own. A null speaker is the participant
    'unknown', a null text is empty, and rows without a conversation id or turn form a dialogue or come first, as nulls
    do. A dialogue of narrators only gives no rows. Extra columns are ignored. Places within a dialogue are summed in parts of it,
    so that no task holds a long dialogue.
    """
    speaker = F.coalesce(F.col(f"`{speaker_col}`").cast("string"), F.lit("unknown"))
    turns = conversations.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), speaker.alias("speaker"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    speakers = stored(turns.where(~F.col("speaker").isin(*NARRATORS)).select("conv_id", F.col("speaker").alias("perspective")).distinct(), "chat-speakers")
    joined = turns.join(speakers.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker").isin(*NARRATORS), F.col("speaker")).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rendered = joined.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    rendered = rendered.withColumn("segment", _segment(F.col("role"), F.col("name"), F.col("text"))).withColumn("size", F.char_length("segment").cast("bigint"))
    # Parts of bounded size in the order of the result, whatever the length of a dialogue; equal rows may change places.
    order = ["turn", "speaker", "text", "tie"]
    rendered = rendered.withColumn("tie", F.monotonically_increasing_id())
    rendered = stored(rendered.repartitionByRange("conv_id", "perspective", *order).withColumn("part", F.spark_partition_id()), "chat-parts")
    totals = rendered.groupBy("conv_id", "perspective", "part").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    # one row per dialogue and part: few, as a dialogue of usual length lies in one or two
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("q"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
    )
    totals = stored(totals, "chat-totals")
    within = Window.partitionBy("conv_id", "perspective", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rendered.withColumn("inner_stop", F.sum("size").over(within)).withColumn("inner_position", F.count("*").over(within) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("q"))
    placed = placed.join(totals, same).withColumn("stop", F.col("chars_before") + F.col("inner_stop"))
    own = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("turns_before") + F.col("inner_position")).alias("position"), "role", "name", "segment",
        (F.col("stop") - F.col("size")).alias("start"), "stop",
        F.when(own, F.col("stop") - F.lit(len("<|end|>\n")) - F.char_length("text")).alias("loss_start"), F.when(own, F.col("stop") - 1).alias("loss_stop"),
    )


#: DuckDB twin of rotate.
SQL = """
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), rendered AS (
  SELECT t.*, s.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), sized AS (
  SELECT *, '<|' || role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment FROM rendered
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w AS stop FROM sized
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, turn, CAST(position AS BIGINT) AS position, role, name, segment, CAST(stop - length(segment) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop,
  CASE WHEN role = 'assistant' THEN CAST(stop - 8 - length(text) AS BIGINT) END AS loss_start, CASE WHEN role = 'assistant' THEN CAST(stop - 1 AS BIGINT) END AS loss_stop
FROM placed
"""
