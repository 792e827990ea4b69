"""Preference formatting: the longest common turn prefix is the prompt; what differs are two masked completions.

A turn is written as <|role|>, a line feed, its text, <|end|> and a line feed. In texts and roles a backslash is doubled and <| becomes
<\\|; in roles |> becomes |\\> and a line feed \\n too. So no text or role can pass for a marker, and different turns are written
differently. The prompt is rendered once from the turns that both conversations begin with; the rest of
each is its completion. A mask lists the spans of characters of a completion that are learned from: the text of assistant turns
and their end markers. A pair is valid if both completions begin with an assistant turn.

A null text is empty, a null role is 'unknown'. Where one conversation is the start of the other, or both are equal, or one is null
or empty, a completion is empty and the pair is not valid. Turns are equal if role and text are. Other columns of pairs are kept;
columns of the names added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ASSISTANT = "assistant"
END = "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(c: Column) -> Column:
    return F.replace(F.replace(escaped(c), F.lit("|>"), F.lit("|\\>")), F.lit("\n"), F.lit("\\n"))


def clean(turns: Column) -> Column:
    """Turns without nulls, escaped."""
    return F.transform(F.coalesce(turns, F.array().cast(TURNS)), lambda t: F.struct(escaped_role(F.coalesce(t["role"], F.lit("unknown"))).alias("role"), escaped(F.coalesce(t["text"], F.lit(""))).alias("text")))


def head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """The learned spans of rendered turns, as (start, end) in characters."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, t):
        begin = acc["at"] + F.char_length(head(t))
        end = begin + F.char_length(t["text"]) + len(END)
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, add)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (chosen, rejected: arrays of role and text) with prompt, n_prompt_turns, and of both sides completion and mask."""
    added = ["prompt", "n_prompt_turns", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask", "valid"]
    a, b, p = fresh(pairs, "a", "b", "p")
    base = pairs.drop(*added).withColumns({a: clean(F.col("chosen")), b: clean(F.col("rejected"))})
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.slice(a, 1, n), lambda t, i: t == F.get(b, i)), F.lit(False))
    base = base.withColumn("n_prompt_turns", F.when(differs > 0, differs - 1).otherwise(n).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    base = base.withColumns({p: F.slice(a, 1, F.col("n_prompt_turns")), a: rest(a), b: rest(b)})
    begins = lambda c: F.coalesce(F.get(c, F.lit(0))["role"] == ASSISTANT, F.lit(False))
    out = base.withColumns(
        {
            "prompt": render(F.col(p)),
            "chosen_completion": render(F.col(a)),
            "chosen_mask": mask(F.col(a)),
            "rejected_completion": render(F.col(b)),
            "rejected_mask": mask(F.col(b)),
            "valid": begins(a) & begins(b),
        }
    )
    return out.drop(p, a, b)


def conversations(table: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order. One conversation is one row of the result, however long.

    Turns of one number are ordered by role and text; a row with a null conv_id is a conversation by itself.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    got = table.select("conv_id", "turn", "role", "text", alone.alias("_alone")).groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    return got.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_reply_pairs(talks: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): rejected repeats the reply before the last instead of the last one; an only reply is blanked.

    Without any reply both sides are equal, which makes no valid pair.
    """
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, i)), lambda i: i.isNotNull())
    last, before = F.get("_r", F.size("_r") - 1), F.get("_r", F.size("_r") - 2)
    other = F.coalesce(F.get("turns", before)["text"], F.lit(""))
    return (
        talks.select("conv_id", "turns", replies.alias("_r"))
        .withColumns({"_last": last, "_other": other})
        .select("conv_id", F.col("turns").alias("chosen"), F.transform("turns", lambda t, i: F.when(i == F.col("_last"), F.struct(t["role"].alias("role"), F.col("_other").alias("text"))).otherwise(t)).alias("rejected"))
    )


def query(table: DataFrame) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return format_pairs(stale_reply_pairs(conversations(table.select("conv_id", "turn", "role", "text")))).select(
        "conv_id",
        F.size("chosen").alias("n_turns"),
        "n_prompt_turns",
        "prompt",
        "chosen_completion",
        shown(F.col("chosen_mask")).alias("chosen_mask"),
        "rejected_completion",
        shown(F.col("rejected_mask")).alias("rejected_mask"),
        "valid",
    )


SQL = r"""
WITH e AS (
  SELECT conv_id, coalesce('c' || conv_id, 'r' || row_number() OVER ()) AS g, turn, role AS o, text AS x,
    replace(replace(replace(replace(coalesce(role, 'unknown'), '\', '\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n') AS r,
    replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') AS t FROM conversations
), n AS (
  SELECT g, conv_id, r, t, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, o NULLS FIRST, x NULLS FIRST) AS i FROM e
), a AS (
  SELECT g, count(*) AS n, max(i) FILTER (WHERE r = 'assistant') AS la FROM n GROUP BY g
), b AS (
  SELECT a.g, a.n, a.la, max(n.i) AS pa FROM a LEFT JOIN n ON n.g = a.g AND n.r = 'assistant' AND n.i < a.la GROUP BY ALL
), c AS (
  SELECT b.*, coalesce(p.t, '') AS other, l.t AS own, CASE WHEN b.la IS NULL OR l.t = coalesce(p.t, '') THEN b.n ELSE b.la - 1 END AS k
  FROM b LEFT JOIN n p ON p.g = b.g AND p.i = b.pa LEFT JOIN n l ON l.g = b.g AND l.i = b.la
), w AS (
  SELECT n.g, n.conv_id, n.i, '<|' || r || '|>' || chr(10) || t || '<|end|>' || chr(10) AS s,
    '<|' || r || '|>' || chr(10) || CASE WHEN i = la THEN other ELSE t END || '<|end|>' || chr(10) AS z FROM n JOIN c USING (g)
)
SELECT any_value(w.conv_id) AS conv_id, c.n::INTEGER AS n_turns, c.k::INTEGER AS n_prompt_turns,
  coalesce(string_agg(w.s, '' ORDER BY w.i) FILTER (WHERE w.i <= c.k), '') AS prompt,
  coalesce(string_agg(w.s, '' ORDER BY w.i) FILTER (WHERE w.i > c.k), '') AS chosen_completion,
  CASE WHEN c.k = c.n THEN '' ELSE '14-' || (22 + length(any_value(c.own))) END AS chosen_mask,
  coalesce(string_agg(w.z, '' ORDER BY w.i) FILTER (WHERE w.i > c.k), '') AS rejected_completion,
  CASE WHEN c.k = c.n THEN '' ELSE '14-' || (22 + length(any_value(c.other))) END AS rejected_mask,
  c.k < c.n AS valid
FROM c JOIN w USING (g) GROUP BY c.g, c.n, c.k
"""
