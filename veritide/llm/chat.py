"""Perspective rotation for multi-party chats, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; system turns stay system turns. The loss mask holds the
code-point ranges of the assistant's own text and end mark.

Turns are taken by (turn, role, text). A dialogue is rendered in parts of PART turn numbers, so no
task has to hold a conversation of any length; each part is a row and no turn is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 256
OPEN, CLOSE = "<|turn|>", "<|end|>\n"


def rotate_perspectives(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART) -> DataFrame:
    """(conv_id, part, speaker, n_turns, n_masked, masked_chars, rendered, mask) per participant and part.

    Null role is the participant "unknown"; null text is empty; null turn comes first, in part -1.
    A conversation of system turns only has no participant and gives no row. Repeated rows are
    repeated turns.
    """
    turns = chats.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.floor(F.col(turn_col) / part_turns), F.lit(-1)).cast("bigint").alias("part"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    speakers = turns.where("t.role <> 'system'").select("conv_id", F.col("t.role").alias("speaker")).distinct()
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    null_safe = [parts["conv_id"].eqNullSafe(speakers["conv_id"])]
    rows = parts.join(speakers, null_safe, "inner").select(parts["conv_id"], "part", "speaker", "turns")

    def segment(t):
        own = t["role"] == F.col("speaker")
        head = F.concat(
            F.lit(OPEN),
            F.when(own, F.lit("assistant")).when(t["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), t["role"])),
            F.lit("\n"),
        )
        return F.struct(own.alias("own"), head.alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"))

    rows = rows.withColumn("segments", F.transform("turns", segment))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("chars"))

    def step(acc, s):
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.concat_ws(":", begin, end)
        return F.struct(
            end.alias("at"),
            F.when(s["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            (acc["chars"] + F.when(s["own"], F.length(s["body"])).otherwise(0)).alias("chars"),
        )

    rows = rows.withColumn("folded", F.aggregate("segments", start, step))
    return rows.select(
        "conv_id",
        "part",
        "speaker",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.size("folded.spans").cast("bigint").alias("n_masked"),
        F.col("folded.chars").cast("bigint").alias("masked_chars"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("rendered"),
        F.array_join("folded.spans", ",").alias("mask"),
    )


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, CAST(coalesce(floor(turn / {PART}.0), -1) AS BIGINT) AS part, turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
g AS (
  SELECT t.conv_id, t.part, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS own,
         '{OPEN}' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system'
                     ELSE 'user name=' || t.role END || chr(10) AS head,
         t.text || '{CLOSE.strip()}' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (
           PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM g)
SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_masked,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS masked_chars,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(upto - length(body) AS BIGINT) || ':' || CAST(upto AS BIGINT) END, ','
                ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM o GROUP BY conv_id, part, speaker
"""
