"""Chat formatting by rotating perspectives: each participant of a dialogue once as the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system"
) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, segment, n_chars, mask): one row for each turn as each participant sees it.

    In a perspective its speaker has the role `assistant` and mask 1 (its tokens are learned), all
    others are users that the header names, mask 0; `system` turns keep their role, are masked and
    are nobody's perspective. The segments of a perspective, in the order of their turns, are the
    rendered dialogue. Segments stay rows, so a dialogue of any length is never gathered in a task:
    dialogues are joined with their participants, of which there are few.

    A null role is the speaker `unknown`, a null text is empty, `<|` within a text or a name becomes
    `< |` so that it can't be taken for a header. A row without conversation id is a dialogue of its
    own, as nothing says what it belongs to; null turns come first. Repeated rows are rendered each. Dialogues of system turns alone give no rows,
    an empty table an empty result; other columns are ignored.
    """
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    given = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        plain(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))).alias("speaker"),
        plain(F.coalesce(F.col(text_col), F.lit(""))).alias("content"),
    )
    people = given.where(F.col("speaker") != system).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    alone = given.where(F.col("conv_id").isNull() & (F.col("speaker") != system)).withColumn("perspective", F.col("speaker"))
    seen = given.join(people, F.col("conv_id") == F.col("__conv")).drop("__conv").unionByName(alone)
    own = F.col("speaker") == F.col("perspective")
    header = (
        F.when(own, F.lit("<|assistant|>"))
        .when(F.col("speaker") == system, F.lit("<|system|>"))
        .otherwise(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>")))
    )
    return seen.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.when(own, "assistant").when(F.col("speaker") == system, "system").otherwise("user").alias("role"),
        F.concat(header, F.lit("\n"), F.col("content"), F.lit("<|end|>\n")).alias("segment"),
        own.cast("int").alias("mask"),
    ).withColumn("n_chars", F.length("segment").cast("long"))


#: DuckDB SQL for op8.
SQL = """
WITH given AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM given WHERE speaker <> 'system'),
shown AS (
  SELECT conv_id, perspective, turn, speaker,
    CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
      ELSE '<|user name=' || speaker || '|>' END || chr(10) || content || '<|end|>' || chr(10) AS segment,
    CAST(speaker = perspective AS INTEGER) AS mask
  FROM (SELECT * FROM given JOIN people ON conv_id = conv UNION ALL SELECT *, NULL, speaker FROM given WHERE conv_id IS NULL AND speaker <> 'system'))
SELECT conv_id, perspective, turn, speaker, role, segment, mask, CAST(length(segment) AS BIGINT) AS n_chars FROM shown
"""
