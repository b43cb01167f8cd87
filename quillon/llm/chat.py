"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant a dialogue is rendered with that speaker as the assistant and all others as
named users; a mask marks what the assistant says. Long dialogues come in parts of PART turn
numbers, so that a row doesn't grow with its dialogue (turns that share a number, or lack one, stand in one part);
parts in order are the whole rendering, and joined() puts those of dialogues that fit a row together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.runtime import session, table

#: Turn numbers in one part of a rendering.
PART = 256
SYSTEM = "system"


def _head(role: Column, me: Column) -> Column:
    """What stands before a turn's text."""
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == me, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, speaker, part, n_turns, rendered, masks for each dialogue, participant and part.

    A turn is rendered as its head, its text, an end marker and a line break; '<|' inside names
    and texts becomes '< |', so nothing can pass for a marker. masks lists the stretches the
    assistant is trained on (its texts and end markers) as start:end in code points of rendered,
    joined by commas. Participants are all speakers but 'system', which is never masked in.

    Turns go by number, then speaker, then text; exact repeats of a turn count once. Null texts
    are empty, null speakers are called 'unknown', null turn numbers come first, and rows without
    a conversation id form one dialogue of their own. A dialogue of system turns only has no rows,
    nor has an empty table; other columns are ignored.
    """
    session(turns.sparkSession)
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        clean(F.coalesce(F.col(role).cast("string"), F.lit("unknown"))).alias("role"),
        F.col(text).cast("string").alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-1)).cast("long"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set(F.struct("turn", "role", clean(F.coalesce("text", F.lit(""))).alias("text")))).alias("turns"))
    # participants come from the speakers alone: texts are shuffled once
    own = rows.select("conv_id", "part", "role").distinct()
    who = own.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    pairs = own.select("conv_id", "part").distinct().join(who, F.col("conv_id").eqNullSafe(F.col("c"))).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "speaker")
    both = parts.join(pairs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))

    me = F.col("speaker")
    heads = both.select("conv_id", "speaker", "part", F.transform("turns", lambda t: F.struct(_head(t["role"], me).alias("head"), F.concat(t["text"], F.lit("<|end|>")).alias("body"), ((t["role"] == me)).alias("mine"))).alias("turns"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + 1).cast("long").alias("at"),
            F.when(t["mine"], F.concat(s["spans"], F.array(F.concat((s["at"] + F.length(t["head"])).cast("string"), F.lit(":"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).cast("string"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return heads.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), F.array_join(walked["spans"], ",").alias("masks"))


def joined(parts: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, rendered, masks: the parts of each rendering in order as one text, with masks moved by
    what stands before. Only for dialogues that fit a row; the parts of others are better written one by one."""
    got = parts.groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "rendered", "masks"))).alias("p"))
    ends = lambda m, at: F.array_join(F.transform(F.split(m, ":"), lambda x: (x.cast("long") + at).cast("string")), ":")
    moved = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("m")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["rendered"])).cast("long").alias("at"),
            F.when(p["masks"] == "", s["m"]).otherwise(F.concat(s["m"], F.transform(F.split(p["masks"], ","), lambda m: ends(m, s["at"])))).alias("m"),
        ),
    )
    return got.select("conv_id", "speaker", "n_turns", F.array_join(F.transform("p", lambda p: p["rendered"]), "").alias("rendered"), F.array_join(moved["m"], ",").alias("masks"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's side."""
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, coalesce(turn // 256, -1) AS part FROM conversations),
w AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
x AS (
  SELECT conv_id, speaker, part, turn, role, text,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM t JOIN w ON conv_id IS NOT DISTINCT FROM c),
y AS (
  SELECT *, row_number() OVER o AS k,
    coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM x WINDOW o AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(text) + 7 AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (role = speaker), '') AS masks
FROM y GROUP BY conv_id, speaker, part
"""
