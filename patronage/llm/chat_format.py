"""Preference data: one prompt and two masked completions from a pair of conversations.

The prompt is the longest common prefix of turns of the chosen and the rejected
conversation, rendered once.  What follows in each is its completion, with the
spans of the assistant's words, which are what a loss may see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import table

TRAINED_ROLE = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def whole(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column) -> Column:
    """start:end of the text of the trained role's turns, in code points of the completion, comma-joined."""
    size = lambda t: F.length(rendered(t))
    before = lambda i: F.aggregate(F.slice(turns, F.lit(1), i), F.lit(0), lambda a, t: a + size(t))
    lead = lambda t: F.length(t["role"]) + 5
    spans = F.transform(
        turns,
        lambda t, i: F.when(
            t["role"] == TRAINED_ROLE,
            F.concat_ws(":", before(i) + lead(t), before(i) + lead(t) + F.length(t["text"])),
        ),
    )
    return F.array_join(F.filter(spans, lambda s: s.isNotNull()), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair that has both sides, from turns (pair_id, side, turn, role, text).

    ``side`` is 'chosen' or 'rejected'.  Turns are ordered by number, then role
    and text; a repeated turn is repeated.  Null roles and texts count as
    empty, null turns come first, turns without pair are ignored.  Equal
    conversations give two empty completions; an empty table gives no rows.
    """
    known = turns.where("pair_id is not null and side in ('chosen', 'rejected')")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A pair's turns are one document; they meet in one row.
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s)
    pairs = known.groupBy("pair_id").agg(side("chosen"), side("rejected")).where("size(chosen) > 0 and size(rejected) > 0")
    same = F.zip_with(
        "chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size("chosen").cast("long")).cast("int")
    split = pairs.withColumn("shared", shared)
    rest = lambda s: F.slice(s, F.col("shared") + 1, F.size(s))
    split = split.select(
        "pair_id", "shared", F.slice("chosen", F.lit(1), F.col("shared")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r")
    )
    return split.select(
        "pair_id",
        F.col("shared").cast("long").alias("n_prompt_turns"),
        whole(F.col("p")).alias("prompt"),
        whole(F.col("c")).alias("chosen"),
        mask(F.col("c")).alias("chosen_mask"),
        whole(F.col("r")).alias("rejected"),
        mask(F.col("r")).alias("rejected_mask"),
    )


def derived_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs made from single conversations: the rejected side ends in the reply of the next one.

    The table holds no preferences.  Chosen is a conversation as it is; rejected
    is the same up to its last assistant turn, which gets the text of the last
    assistant turn of the conversation whose id is larger by one.  Where that
    conversation is missing or has no assistant turn, the text is empty.  A
    conversation without assistant turn is both sides, so its completions are
    empty.  Every conversation with an id gives a pair.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    replies = turns.where(F.col("role") == TRAINED_ROLE)
    last = replies.groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
    last = last.select("conv_id", F.col("l.turn").alias("last_turn"), F.col("l.text").alias("last_text"))
    foreign = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last_text").alias("foreign_text"))
    ends = last.select("conv_id", "last_turn", F.lit(True).alias("replied")).join(foreign, "conv_id", "left")
    both = turns.join(ends, "conv_id", "left")
    chosen = both.select("conv_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    reply = F.col("turn").eqNullSafe(F.col("last_turn")) & (F.col("role") == TRAINED_ROLE)
    swapped = F.when(reply, F.coalesce("foreign_text", F.lit(""))).otherwise(F.col("text"))
    # Replies whose turns are all null end at null turns.
    kept = both.where("replied is null or turn <= last_turn or (turn is null and last_turn is null)")
    rejected = kept.select("conv_id", F.lit("rejected").alias("side"), "turn", "role", swapped.alias("text"))
    return chosen.unionByName(rejected).withColumnRenamed("conv_id", "pair_id")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """A pair for every conversation of ``conversations`` with an id; see ``derived_pairs`` and ``format_preferences``."""
    return format_preferences(derived_pairs(table(spark, sf_dir, "conversations")))


def completion_sql(side: str) -> str:
    return f"""array_to_string(list_transform({side}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"""


def mask_rows_sql(side: str) -> str:
    return f"""
{side}_masks AS (
  SELECT pair_id, coalesce(string_agg(CASE WHEN role = 'assistant' THEN (b + length(role) + 5) || ':' || (b + length(role) + 5 + length(text)) END, ',' ORDER BY i), '') AS {side}_mask
  FROM (SELECT pair_id, i, t.role AS role, t.text AS text,
               CAST(coalesce(sum(length(t.role) + length(t.text) + 13) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
        FROM (SELECT pair_id, generate_subscripts({side}, 1) AS i, unnest({side}) AS t FROM rests))
  GROUP BY pair_id)"""


OP8_SQL = f"""
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (
  SELECT conv_id, l.turn AS last_turn, l.text AS last_text
  FROM (SELECT conv_id, max(struct_pack(turn := turn, text := coalesce(text, ''))) AS l FROM turns WHERE role = 'assistant' GROUP BY conv_id)),
ends AS (
  SELECT a.conv_id, a.last_turn, coalesce(b.last_text, '') AS foreign_text, true AS replied
  FROM lasts a LEFT JOIN lasts b ON b.conv_id = a.conv_id + 1),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM turns
  UNION ALL
  SELECT conv_id, 'rejected', turn, role,
         CASE WHEN turn IS NOT DISTINCT FROM last_turn AND role = 'assistant' THEN foreign_text ELSE text END
  FROM turns LEFT JOIN ends USING (conv_id)
  WHERE replied IS NULL OR turn <= last_turn OR (turn IS NULL AND last_turn IS NULL)),
filled AS (SELECT pair_id, side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM sides),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS place FROM filled),
aligned AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.place, b.place) AS place,
         coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM numbered WHERE side = 'chosen') a
  FULL JOIN (SELECT * FROM numbered WHERE side = 'rejected') b ON a.pair_id = b.pair_id AND a.place = b.place),
prefixes AS (SELECT pair_id, coalesce(min(place) FILTER (NOT same) - 1, max(place)) AS shared FROM aligned GROUP BY pair_id),
rests AS (
  SELECT pair_id, shared,
         coalesce(list(struct_pack(role := role, text := text) ORDER BY place) FILTER (side = 'chosen' AND place <= shared), []) AS prompt,
         coalesce(list(struct_pack(role := role, text := text) ORDER BY place) FILTER (side = 'chosen' AND place > shared), []) AS chosen,
         coalesce(list(struct_pack(role := role, text := text) ORDER BY place) FILTER (side = 'rejected' AND place > shared), []) AS rejected
  FROM numbered JOIN prefixes USING (pair_id) GROUP BY pair_id, shared),
{mask_rows_sql("chosen")},
{mask_rows_sql("rejected")}
SELECT pair_id, shared AS n_prompt_turns, {completion_sql("prompt")} AS prompt,
       {completion_sql("chosen")} AS chosen, coalesce(chosen_mask, '') AS chosen_mask,
       {completion_sql("rejected")} AS rejected, coalesce(rejected_mask, '') AS rejected_mask
FROM rests LEFT JOIN chosen_masks USING (pair_id) LEFT JOIN rejected_masks USING (pair_id)
"""
