"""Operator 5: preference formatting of conversation pairs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template: <|role|>\n text <|end|>\n. The mark "<|" in a role or a text is
#: broken by a backslash, so that no text can open or end a turn.
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row for each conversation: its turns as (role, text, head, body) in order, rendered, with
    the place ``at`` where each begins in the rendered conversation."""
    safe = lambda c, other: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(other)), F.lit("<|"), F.lit("<\\|"))
    t = conversations.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.concat(F.lit(ROLE_OPEN), safe(role_col, "unknown"), F.lit(ROLE_CLOSE)).alias("head"),
        F.concat(safe(text_col, ""), F.lit(TURN_CLOSE)).alias("body"),
    ).where("conv IS NOT NULL")
    # Places are sums over the turns before; turns that are equal in all render alike, so any order of them will do.
    size = (F.char_length("head") + F.char_length("body")).cast("long")
    before = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = t.withColumn("at", F.sum(size).over(before) - size)
    listed = F.array_sort(F.collect_list(F.struct("at", "role", "text", "head", "body")))
    return placed.groupBy("conv").agg(listed.alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(x["head"], x["body"])), "")


def _mask(turns: Column) -> Column:
    """"begin:end" of the text that is trained on, in code points of the rendered turns: what a
    trained role says, with the mark that ends its turn. Everything else is masked."""
    trained = F.filter(turns, lambda x: x["role"] == TRAINED_ROLE)

    def span(x: Column) -> Column:
        begin = x["at"] - turns[0]["at"] + F.char_length(x["head"])
        return F.concat_ws(":", begin.cast("string"), (begin + F.char_length(x["body"])).cast("string"))

    return F.array_join(F.transform(trained, span), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of conversations as prompt and two masked completions.

    chosen, rejected: pair_id and turns (as ``conversation_turns`` gives them). One row for each
    pair_id of either: prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. The
    prompt is the longest prefix of turns that are equal in role and text, rendered once. What
    follows in either is its completion; the mask lists the spans of it that are trained on.

    A side that is missing has a null completion and mask, and then the other one's turns up to
    its last trained turn are the prompt. Equal conversations have empty completions.
    """
    return format_pairs(chosen.select("pair_id", F.col("turns").alias("c")).join(rejected.select("pair_id", F.col("turns").alias("r")), "pair_id", "full_outer"))


def format_pairs(both: DataFrame) -> DataFrame:
    """``format_preferences`` of pairs that are together already: pair_id and the turns c and r."""
    short = F.least(F.size("c"), F.size("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differ = F.array_position(same, False).cast("int")
    common = F.when(differ > 0, differ - 1).otherwise(short)
    only = F.coalesce("c", "r")
    back = F.array_position(F.reverse(F.transform(only, lambda x: x["role"])), TRAINED_ROLE).cast("int")
    alone = F.when(back > 0, F.size(only) - back).otherwise(F.size(only))
    cut = both.withColumn("prompt_turns", F.when(F.col("c").isNull() | F.col("r").isNull(), alone).otherwise(common).cast("int"))
    rest = lambda x: F.slice(x, F.col("prompt_turns") + 1, F.greatest(F.size(x) - F.col("prompt_turns"), F.lit(0)))
    ended = cut.select("pair_id", "prompt_turns", F.slice(only, F.lit(1), F.col("prompt_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return ended.select(
        "pair_id",
        "prompt_turns",
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def conversation_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turns: the turns of each conversation in order of turn, role, text.

    Null turns come last; a null role is 'unknown', a null text empty; rows with a null
    conversation belong to none and are left out. Rows that repeat count as turns of their own.
    A conversation is gathered in one row, as it is rendered into one.
    """
    return _turns(conversations, conv_col, turn_col, role_col, text_col)


def neighbours(conversations: DataFrame, **columns: str) -> DataFrame:
    """Preferences of a table of conversations without verdicts: conversations 2n and 2n + 1 are
    chosen and rejected of pair n. Ids pair by arithmetic, so no popular opening meets in a task."""
    t = conversation_turns(conversations, **columns).withColumn("pair_id", F.shiftright("conv", 1)).withColumn("odd", F.col("conv").bitwiseAND(F.lit(1)) == 1)
    # One aggregate brings both sides of a pair together.
    return format_pairs(t.groupBy("pair_id").agg(F.max_by("turns", F.when(~F.col("odd"), 1)).alias("c"), F.max_by("turns", F.when(F.col("odd"), 1)).alias("r")))


_SQL_TURNS = """list_transform({t}, lambda x: '<|' || replace(x.role, '<|', '<\\|') || '|>' || chr(10) || replace(x.text, '<|', '<\\|') || '<|end|>' || chr(10))"""
_SQL_MASK = """array_to_string(list_transform(list_filter(range(1, len({t}) + 1), lambda i: {t}[i].role = 'assistant'), lambda i:
  (coalesce(list_sum(list_transform({s}[1:i - 1], lambda y: len(y))), 0) + len(replace({t}[i].role, '<|', '<\\|')) + 5)::BIGINT::VARCHAR || ':' ||
  list_sum(list_transform({s}[1:i], lambda y: len(y)))::BIGINT::VARCHAR), ',')"""
SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}} ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (
  SELECT coalesce(c.conv_id // 2, r.conv_id // 2) AS pair_id, c.t AS c, r.t AS r
  FROM (SELECT * FROM t WHERE conv_id % 2 = 0) c FULL JOIN (SELECT * FROM t WHERE conv_id % 2 = 1) r ON c.conv_id // 2 = r.conv_id // 2),
n AS (
  SELECT *, coalesce(c, r) AS o,
    CASE WHEN c IS NULL OR r IS NULL
         THEN coalesce(list_max(list_filter(range(1, len(coalesce(c, r)) + 1), lambda i: coalesce(c, r)[i].role = 'assistant')) - 1, len(coalesce(c, r)))
         ELSE coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) END::INTEGER AS prompt_turns
  FROM p),
k AS (SELECT pair_id, prompt_turns, o[1:prompt_turns] AS p, c[prompt_turns + 1:] AS c, r[prompt_turns + 1:] AS r FROM n),
s AS (SELECT *, {_SQL_TURNS.format(t='p')} AS sp, {_SQL_TURNS.format(t='c')} AS sc, {_SQL_TURNS.format(t='r')} AS sr FROM k)
SELECT pair_id, prompt_turns, array_to_string(sp, '') AS prompt, array_to_string(sc, '') AS chosen, array_to_string(sr, '') AS rejected,
       {_SQL_MASK.format(t='c', s='sc')} AS chosen_mask, {_SQL_MASK.format(t='r', s='sr')} AS rejected_mask
FROM s
"""
