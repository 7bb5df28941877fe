"""Operator 5: preference formatting of chosen and rejected conversations (native).

The longest common prefix of turns is rendered once as the prompt; what follows becomes a
pair of completions with loss masks, which cover the assistant's words only.

Scale: both sides are rows of one table, dealt once by pair; all that follows (numbering the
turns, laying the sides over each other, finding where they part, rendering) keeps to that
one exchange. Only the final rendering gathers a pair's own turns into its row.

Edge cases: turns are ordered by (turn, role, text), a null turn comes first, so repeated rows
stay, in place; rows without a pair's id are one pair, whose id is null; a null role reads
``unknown``, a null text is empty; sides that never part have empty completions; a side that
ends early has an empty completion; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


FIRST = -(2**63) + 1  # where a null turn stands


def both_sides(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, side (c or r), turn, role, text of two tables of turns."""
    a, b = (d.select("pair_id", F.lit(side).alias("side"), F.col("turn").cast("long").alias("turn"), "role", "text") for d, side in ((chosen, "c"), (rejected, "r")))
    return a.unionByName(b)


def segments(turns: DataFrame) -> DataFrame:
    """pair_id, n_common, side (prompt, chosen, rejected), pos, rendered, head, said.

    ``head`` is the length of what stands before the turn's words, ``said`` that of the words
    that count for the loss. Input: pair_id, side, turn, role, text.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    d = turns.select("pair_id", "side", F.coalesce("turn", F.lit(FIRST)).alias("turn"), "role", role.alias("_role"), text.alias("text")).repartition("pair_id")
    order = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    d = d.withColumn("pos", F.row_number().over(order))
    said = F.struct(F.col("_role").alias("role"), "text")
    both = d.groupBy("pair_id", "pos").agg(F.max(F.when(F.col("side") == "c", said)).alias("c"), F.max(F.when(F.col("side") == "r", said)).alias("r"))
    same = F.col("c").isNotNull() & F.col("c").eqNullSafe(F.col("r"))
    pair = Window.partitionBy("pair_id")
    rows = both.withColumn("n_common", F.coalesce(F.min(F.when(~same, F.col("pos"))).over(pair) - 1, F.max("pos").over(pair)))
    common = F.col("pos") <= F.col("n_common")
    sides = F.array(
        F.when(common, F.struct(F.lit("prompt").alias("side"), F.col("c").alias("t"))),
        F.when(~common & F.col("c").isNotNull(), F.struct(F.lit("chosen").alias("side"), F.col("c").alias("t"))),
        F.when(~common & F.col("r").isNotNull(), F.struct(F.lit("rejected").alias("side"), F.col("r").alias("t"))),
    )
    rows = rows.select("pair_id", "n_common", "pos", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s"))
    role, text = F.col("s.t.role"), F.col("s.t.text")
    head = F.concat(F.lit(OPEN), role, F.lit(CLOSE))
    return rows.select("pair_id", "n_common", "pos", F.col("s.side").alias("side"), F.concat(head, text, F.lit(END)).alias("rendered"), F.length(head).alias("head"), F.when(role == "assistant", F.length(text) + len(END)).alias("said"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair: n_common, prompt, chosen, rejected and their masks; see ``both_sides``
    for the input.

    A mask lists ``start:length`` of the code points of its completion that count for the
    loss: an assistant turn's words and end mark.
    """
    rows = segments(turns)
    before = Window.partitionBy("pair_id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)))
    span = F.when(F.col("said").isNotNull(), F.concat_ws(":", F.col("at") + F.col("head"), "said"))
    rows = rows.groupBy("pair_id", "n_common").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "rendered", span.alias("span")))).alias("_s"))

    def of(side: str, field: str, sep: str) -> Column:
        return F.array_join(F.transform(F.filter("_s", lambda x: x["side"] == side), lambda x: x[field]), sep)

    return rows.select("pair_id", F.col("n_common").cast("long").alias("n_common"), of("prompt", "rendered", "").alias("prompt"), of("chosen", "rendered", "").alias("chosen"), of("rejected", "rendered", "").alias("rejected"), of("chosen", "span", ",").alias("chosen_mask"), of("rejected", "span", ",").alias("rejected_mask"))


def contrast(conversations: DataFrame) -> DataFrame:
    """Both sides (see ``both_sides``) from plain conversations, each up to its last assistant turn.

    The rejected side repeats the conversation's first assistant reply in place of the last
    one; where there is only one, it echoes the turn before. Conversations without an
    assistant turn make no pair.
    """
    w = Window.partitionBy("conv_id")
    d = conversations.select(F.col("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    d = d.withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)).filter("turn <= last")
    first = F.min(F.when((F.col("role") == "assistant") & (F.col("turn") < F.col("last")), F.struct("turn", "text"))).over(w)
    echo = F.max(F.when(F.col("turn") < F.col("last"), F.struct("turn", "text"))).over(w)
    d = d.withColumn("other", F.coalesce(first["text"], echo["text"], F.lit("")))
    swap = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    sides = F.array(F.struct(F.lit("c").alias("side"), F.col("text").alias("text")), F.struct(F.lit("r").alias("side"), F.when(swap, F.col("other")).otherwise(F.col("text")).alias("text")))
    return d.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(contrast(table(spark, sf_dir, "conversations")))


QUERIES = {"op5_chat_format": op5_chat_format}
SQL = {
    "op5_chat_format": r"""
WITH c AS (SELECT conv_id, coalesce(turn, -9223372036854775807) AS turn, role, coalesce(text, '') AS text FROM conversations),
d0 AS (
  SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM c),
d AS (
  SELECT *, coalesce(
      min(CASE WHEN role = 'assistant' AND turn < last THEN {'t': turn, 'x': text} END) OVER w,
      max(CASE WHEN turn < last THEN {'t': turn, 'x': text} END) OVER w, {'t': 0, 'x': ''}).x AS other
  FROM d0 WHERE turn <= last WINDOW w AS (PARTITION BY conv_id)),
r AS (
  SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text) AS pos,
         coalesce(role, 'unknown') AS role, text,
         CASE WHEN turn = last AND role = 'assistant' THEN other ELSE text END AS text2
  FROM d),
p AS (
  SELECT *, coalesce(min(CASE WHEN text <> text2 THEN pos END) OVER (PARTITION BY pair_id) - 1,
                     max(pos) OVER (PARTITION BY pair_id)) AS n_common FROM r),
s AS (
  SELECT pair_id, n_common, pos, role, 'prompt' AS side, text FROM p WHERE pos <= n_common
  UNION ALL SELECT pair_id, n_common, pos, role, 'chosen', text FROM p WHERE pos > n_common
  UNION ALL SELECT pair_id, n_common, pos, role, 'rejected', text2 FROM p WHERE pos > n_common),
t AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, length(role) + 5 AS head FROM s),
u AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, side ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM t),
v AS (
  SELECT *, CASE WHEN role = 'assistant' THEN (begins + head)::VARCHAR || ':' || (length(text) + 8)::VARCHAR END AS span FROM u)
SELECT pair_id, n_common,
  coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (side = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (side = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (side = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'chosen'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 'rejected'), '') AS rejected_mask
FROM v GROUP BY pair_id, n_common
""",
}
