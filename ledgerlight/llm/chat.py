"""Preference formatting: a chosen and a rejected conversation as one prompt and two masked completions.

The turns that both conversations begin with (same role and text, turn by turn) are rendered once as the prompt; what
follows in each is rendered as its completion. A completion's mask names the code points that a loss counts: the text and the
end mark of each assistant turn. The longest common prefix is taken, so the completion of a conversation that is
wholly a prefix of the other one is empty.

One row is one pair, and holds both conversations whole, so a conversation is gathered as the one record that it is. All of it is DataFrame functions.

Defined cases: a null role reads ``unknown``, a null text is empty; turns follow their number, a null one first, then role and text; rows
repeated in full are turns like others; turns without a conversation id belong to none and are left out; a conversation
without a partner gives a row whose other side is null, with its own turns as completion and an empty prompt; control
marks inside a text are broken up by a space; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chat template.
BEGIN, END = "<|im_start|>", "<|im_end|>"
MARK, BROKEN = "<|im_", "< |im_"
LEARNED = "assistant"


def _rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n")))


def _mask(turns: Column) -> Column:
    """start:end of each assistant turn's text and end mark among the rendered turns, comma-joined."""
    head, tail = len(BEGIN) + 1, len(END) + 1

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head + F.length(t["role"])
        end = begin + F.length(t["text"]) + tail
        span = F.concat_ws(":", begin.cast("string"), (end - 1).cast("string"))
        spans = F.when(t["role"] == LEARNED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row per pair.

    ``turns`` has conv_id, turn, role and text; ``pair`` names the pair of a conversation, ``chosen`` tells whether it is the
    chosen one. Columns: pair_id, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask,
    chosen_turns, rejected_turns (numbers of turns in the completions).
    """

    def clean(c: str, default: str) -> Column:
        return F.replace(F.coalesce(F.col(c).cast("string"), F.lit(default)), F.lit(MARK), F.lit(BROKEN)).alias(c)

    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        pair.cast("long").alias("pair_id"), chosen.alias("is_chosen"), F.struct(F.col("turn").cast("long").alias("turn"), clean("role", "unknown"), clean("text", "")).alias("t")
    )
    rows = rows.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_chosen"), F.col("t")))).alias("a"),
        F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), F.col("t")))).alias("b"),
    )
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(F.least(F.size("a"), F.size("b"))).cast("int")
    rows = rows.withColumn("k", common)

    def rest(c: str) -> Column:
        return F.slice(c, F.col("k") + 1, F.greatest(F.size(c) - F.col("k"), F.lit(0)))

    def known(c: str, value: Column) -> Column:
        return F.when(F.size(c) > 0, value)

    return rows.select(
        "pair_id",
        F.array_join(_rendered(F.slice("a", F.lit(1), F.col("k"))), "").alias("prompt"),
        F.col("k").alias("prompt_turns"),
        known("a", F.array_join(_rendered(rest("a")), "")).alias("chosen"),
        known("b", F.array_join(_rendered(rest("b")), "")).alias("rejected"),
        known("a", _mask(rest("a"))).alias("chosen_mask"),
        known("b", _mask(rest("b"))).alias("rejected_mask"),
        known("a", F.size("a") - F.col("k")).alias("chosen_turns"),
        known("b", F.size("b") - F.col("k")).alias("rejected_turns"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """``preference_pairs`` of conversations 2n (chosen) and 2n + 1 (rejected)."""
    conv = F.col("conv_id").cast("long")
    return preference_pairs(turns, F.shiftright(conv, 1), F.pmod(conv, F.lit(2)) == 0)


NEIGHBOURS_SQL = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side,
         replace(coalesce(role, 'unknown'), '{MARK}', '{BROKEN}') AS role,
         replace(coalesce(text, ''), '{MARK}', '{BROKEN}') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
d AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
p AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS k FROM d GROUP BY pair_id),
r AS (
  SELECT t.*, p.k, '{BEGIN}' || role || chr(10) || text || '{END}' || chr(10) AS body,
         {len(BEGIN) + 1} + length(role) AS head, length(text) + {len(END)} AS learned
  FROM t JOIN p USING (pair_id)),
s AS (
  SELECT *, coalesce(sum(length(body)) FILTER (WHERE i > k) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM r),
c AS (
  SELECT pair_id, side, coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE i > k), '') AS completion,
         coalesce(string_agg(CAST(CAST(begins + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begins + head + learned AS BIGINT) AS VARCHAR), ',' ORDER BY i)
                  FILTER (WHERE i > k AND role = '{LEARNED}'), '') AS mask,
         count(*) FILTER (WHERE i > k) AS n
  FROM s GROUP BY pair_id, side),
q AS (SELECT pair_id, string_agg(body, '' ORDER BY i) AS prompt FROM s WHERE side = 0 AND i <= k GROUP BY pair_id)
SELECT p.pair_id, coalesce(q.prompt, '') AS prompt, CAST(p.k AS INT) AS prompt_turns, a.completion AS chosen, b.completion AS rejected,
       a.mask AS chosen_mask, b.mask AS rejected_mask, CAST(a.n AS INT) AS chosen_turns, CAST(b.n AS INT) AS rejected_turns
FROM p LEFT JOIN q USING (pair_id)
LEFT JOIN (SELECT * FROM c WHERE side = 0) a ON a.pair_id = p.pair_id
LEFT JOIN (SELECT * FROM c WHERE side = 1) b ON b.pair_id = p.pair_id
"""

