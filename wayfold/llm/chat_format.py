"""Preference formatting of chosen and rejected conversations.

Both conversations of a pair are rendered turn by turn. Their longest common
prefix of equal turns (role and text) is rendered once as the prompt; what
follows in each is its completion. A mask gives, for every turn of a completion,
its characters and whether they are trained on: 1 for assistant turns, 0 for any
other. Only SQL functions are used; rows meet once, by pair.

A null text counts as empty and a null role as "user". Turns of one conversation
with the same number are ordered by role, then text. A pair of which one side is
missing has an empty prompt and an empty completion on that side. Two equal
conversations have everything in the prompt. Pairs with a null id are dropped,
since nothing says which rows belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen, rejected: (pair_id, turn, role, text). Returns pair_id,
    n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    both = chosen.select("pair_id", "turn", "role", "text", F.lit(True).alias("_c")).unionByName(rejected.select("pair_id", "turn", "role", "text", F.lit(False).alias("_c")))
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    side = lambda own: F.transform(F.array_sort(F.collect_list(F.when(F.col("_c") == own, turn))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # A conversation is read as one row by whatever uses it; a pair is two of them.
    pairs = both.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    differs = F.filter(F.sequence(F.lit(0), F.least(F.size("c"), F.size("r"))), lambda i: ~F.get("c", i).eqNullSafe(F.get("r", i)) | (i == F.least(F.size("c"), F.size("r"))))
    pairs = pairs.withColumn("n", F.element_at(differs, 1))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    shown = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + F.lit(6)
    masks = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(size(t).cast("string"), F.lit(":"), F.when(t["role"] == "assistant", "1").otherwise("0"))), ",")
    return pairs.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), shown(F.slice("c", 1, F.col("n"))).alias("prompt"),
        shown(rest("c")).alias("chosen"), shown(rest("r")).alias("rejected"), masks(rest("c")).alias("chosen_mask"), masks(rest("r")).alias("rejected_mask"),
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of a table that holds chosen and rejected conversations in turn:
    conv_id 2k is the chosen one of pair k and 2k + 1 the rejected one."""
    own = conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), "turn", "role", "text", F.pmod("conv_id", F.lit(2)).alias("_side"))
    return preference_pairs(own.where("_side = 0"), own.where("_side = 1"))


PAIRS_SQL = """
WITH own AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
marked AS (
  SELECT own.*, (o.pair_id IS NULL) AS differs
  FROM own LEFT JOIN own o ON o.pair_id = own.pair_id AND o.side = 1 - own.side AND o.pos = own.pos AND o.role = own.role AND o.text = own.text),
cut AS (
  SELECT *, max(CAST(differs AS INT)) OVER (PARTITION BY pair_id, side ORDER BY pos) AS after,
         '<|' || role || '|>' || chr(10) || text || chr(10) AS shown,
         CAST(length(role) + length(text) + 6 AS VARCHAR) || ':' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS mask
  FROM marked)
SELECT pair_id,
  coalesce(count(*) FILTER (after = 0 AND side = 0), 0) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (after = 0 AND side = 0), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (after = 1 AND side = 0), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (after = 1 AND side = 1), '') AS rejected,
  coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (after = 1 AND side = 0), '') AS chosen_mask,
  coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (after = 1 AND side = 1), '') AS rejected_mask
FROM cut GROUP BY pair_id
"""
