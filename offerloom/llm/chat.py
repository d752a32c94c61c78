"""Chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering in which that speaker is the assistant
and all others are named users; only the assistant's turns, with their end marks, are
trained on. System turns stay system turns in every rendering. The result has a row per
rendering and turn, with the turn's place in the rendering, its offset in the rendered
text and the span to train on, so a dialogue of any length needs no task of its own: offsets
are sums over blocks of ``TURNS`` turns, then within a block.

Cases: a null text is empty; a null role is the speaker "unknown"; turns without a
number come first; turns that share a number, or have none, are ordered by role, then text,
within one task; rows without a dialogue id are one dialogue; a dialogue of system turns alone has no
participant and no row; marks inside a text or role are broken up, and line breaks inside a role
become spaces, so that they never read as marks; texts of any length are rendered whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS = 1024
BEGIN, END = "<|im_start|>", "<|im_end|>"

ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
rendered AS (
  SELECT s.*, p.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN speaker <> 'system' AND speaker <> perspective THEN speaker END AS name
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), texts AS (
  SELECT *, '{BEGIN}' || role || coalesce(' name=' || replace(replace(replace(name, '<|', '< |'), chr(10), ' '), chr(13), ' '), '') || chr(10) AS head, content || '{END}' || chr(10) AS body FROM rendered
), placed AS (
  SELECT *, head || body AS rendered_text,
    row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content) - 1 AS position,
    coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM texts
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, role, name, rendered_text, CAST(start AS BIGINT) AS start,
  CASE WHEN role = 'assistant' THEN CAST(start + length(head) AS BIGINT) END AS train_from,
  CASE WHEN role = 'assistant' THEN CAST(start + length(head || body) - 1 AS BIGINT) END AS train_to
FROM placed
"""


def rotated(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, name, rendered_text, start, train_from, train_to; spans in code points."""
    said = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"))
    people = said.where("speaker <> 'system'").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    role = F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    name = F.when((F.col("speaker") != "system") & (F.col("speaker") != F.col("perspective")), F.col("speaker"))
    turns = (
        said.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
        .withColumn("role", role)
        .withColumn("name", name)
        .withColumn("head", F.concat(F.lit(BEGIN), "role", F.coalesce(F.concat(F.lit(" name="), F.translate(F.replace("name", F.lit("<|"), F.lit("< |")), "\n\r", "  ")), F.lit("")), F.lit("\n")))
        .withColumn("rendered_text", F.concat("head", "content", F.lit(END + "\n")))
        .withColumn("size", F.length("rendered_text").cast("long"))
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))))
    )
    key = ["conv_id", "perspective"]
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy(*key, "block").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("perspective").alias("b_who"), F.col("block").alias("b_block"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    inside = Window.partitionBy(*key, "block").orderBy(F.asc_nulls_first("turn"), "speaker", "content")
    placed = (
        turns.withColumn("k", F.row_number().over(inside) - 1)
        .withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_who")) & (F.col("block") == F.col("b_block")))
        .withColumn("start", F.col("s") + F.col("before"))
    )
    mine = F.col("role") == "assistant"
    return placed.select(
        *key, (F.col("n") + F.col("k")).cast("long").alias("position"), "turn", "speaker", "role", "name", "rendered_text", F.col("start").cast("long").alias("start"),
        F.when(mine, F.col("start") + F.length("head")).cast("long").alias("train_from"),
        F.when(mine, F.col("start") + F.col("size") - 1).cast("long").alias("train_to"),
    )
