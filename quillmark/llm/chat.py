r"""Multi-party chat formatting by perspective rotation.

A conversation is rendered once for every participant: that speaker's messages become the
assistant's, everyone else's become a user's, with the speaker's name, and the mask marks exactly the
assistant's words (and their end mark) as the text to learn. Messages of NON_SPEAKERS are instructions:
they are rendered under their own name in every perspective, and have none of their own.

    <|system|>            <|user|> name:            <|assistant|>
    text<|end|>           text<|end|>               text<|end|>

A conversation's messages are ordered by turn, role and text. Renderings are cut into segments of
SEGMENT turn numbers, and these every PART_ROWS messages in that order: part = place in the segment
div PART_ROWS, so that no row grows with its conversation and (segment, part) numbers rows in order.
Places come from sorted ranges of all messages, however many one conversation or turn has. Messages
of a conversation meet its participants by a join, which adaptive execution splits for a hot
conversation; nothing is gathered but the messages of one part. Only DataFrame functions are used.

What a speaker writes cannot end a message or begin another: in texts and roles a backslash is put
before the bar of every ``<|`` (and of ``<\|``, ``<\\|`` ...), so that ``<|`` stands in a rendering only
where the format puts it; in roles, line ends are written ``\n`` and backslashes ``\\``. ``unescaped`` undoes it,
and a rendering can be parsed back to its messages.

Defined results: rows equal in all four columns are one message; a null text is empty; a null role is
the participant `unknown`; messages without a turn come last, in segments of their own (-1); rows
without conv_id form one conversation; a conversation of instructions only has no rendering. Other
columns are ignored. Mask offsets count code points of the row's text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranking import ranked
from .common import documents, materialize

NON_SPEAKERS = ("system",)
UNKNOWN = "unknown"
END = "<|end|>"
SEGMENT = 64
PART_ROWS = 256


def escaped(text: Column) -> Column:
    """text without the format's own marks: one more backslash before the bar that follows a ``<``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role as one line of its own."""
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(plain)


def unescaped(text: str) -> str:
    """What a speaker wrote, from its rendering."""
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _piece(role: Column, speaker: Column) -> tuple[Column, Column]:
    """What stands before a message's text, and whether it is to be learned."""
    own = role == speaker
    head = F.when(own, F.lit("<|assistant|>\n")).when(role.isin(*NON_SPEAKERS), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user|> "), escaped_role(role), F.lit(":\n")))
    return head, own


def messages(table: DataFrame) -> DataFrame:
    """Distinct messages with the segment and part that they belong to."""
    rows = table.select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-1)).cast("bigint"))
    rows = ranked(rows, F.col("conv_id"), F.col("segment"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), name="place")
    first = rows.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    # In the others every message's part is 0.
    first = materialize(first.filter(F.col("n") > PART_ROWS).select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "first"), "large-segments")
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment")), "left")
    part = F.floor((F.col("place") - F.col("first")) / PART_ROWS)
    return joined.select("conv_id", "turn", "role", "text", "segment", F.coalesce(part, F.lit(0)).cast("bigint").alias("part"))


def perspectives(table: DataFrame) -> DataFrame:
    """conv_id, perspective, segment, part, n_messages, text and mask (array of start, end)."""
    rows = materialize(messages(table), "chat-messages")
    speakers = rows.filter(~F.col("role").isin(*NON_SPEAKERS)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    speakers = materialize(speakers, "speakers")
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    head, own = _piece(F.col("role"), F.col("perspective"))
    # Ordered by what was said, shown as escaped.
    item = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", F.col("text").alias("said"), head.alias("head"), own.alias("own"), escaped(F.col("text")).alias("text"))
    groups = seen.groupBy("conv_id", "perspective", "segment", "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = lambda x: F.concat(x["head"], x["text"], F.lit(END + "\n"))
    size = lambda x: F.char_length(whole(x)).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["head"])
        span = F.struct(begin.alias("start"), (begin + F.char_length(x["text"]) + len(END)).alias("end"))
        return F.struct((state["at"] + size(x)).alias("at"), F.when(x["own"], F.concat(state["mask"], F.array(span))).otherwise(state["mask"]).alias("mask"))

    return groups.select("conv_id", "perspective", "segment", "part", F.size("items").cast("bigint").alias("n_messages"), F.array_join(F.transform("items", whole), "").alias("text"), F.aggregate("items", start, step)["mask"].alias("mask"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return perspectives(documents(spark, sf_dir, "conversations")).withColumn("mask", mask)


#: For segments of at most PART_ROWS messages, which is every one of these tables'.
OP8_SQL = """
WITH messages AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         coalesce(floor(turn / 64), -1)::BIGINT AS segment
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM messages WHERE role <> 'system'),
seen AS (
  SELECT m.*, s.perspective, m.role = s.perspective AS own,
         CASE WHEN m.role = s.perspective THEN '<|assistant|>' || chr(10)
              WHEN m.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user|> ' || m.role || ':' || chr(10) END AS head
  FROM messages m JOIN speakers s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, length(head || text || '<|end|>') + 1 AS size,
         coalesce(sum(length(head || text || '<|end|>') + 1) OVER (
           PARTITION BY conv_id, perspective, segment ORDER BY turn NULLS LAST, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_char,
         row_number() OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn NULLS LAST, role, text) AS nr
  FROM seen)
SELECT conv_id, perspective, segment, 0::BIGINT AS part, count(*)::BIGINT AS n_messages,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY nr) AS text,
       coalesce(string_agg((at_char + length(head)) || '-' || (at_char + size - 1), ',' ORDER BY nr) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective, segment
"""

QUERIES = {"op8_chat": op8_chat}
ORACLES = {"op8_chat": OP8_SQL}
