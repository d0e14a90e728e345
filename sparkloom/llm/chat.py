"""Preference formatting with DataFrame functions only: one prompt, two masked completions.

A conversation is an array of (role, text). The prompt is the longest common prefix of whole turns of the chosen and the
rejected conversation, rendered once; the completions are what follows on either side. A completion's mask has runs of
(chars, train): a turn's header is never trained on, its body (with the end mark) only where the assistant speaks.

Null roles are rendered as ``unknown``, null texts as empty. ``<|`` inside a text becomes ``< |``, so that no text can
forge a turn. Equal conversations give empty completions, and so does a missing side. Turns given twice count once;
turns with the same number are ordered by role and text, nulls first. Rows without a conversation id belong to no
conversation and are left out; ids that aren't whole numbers have no neighbour. A conversation is one training example
and is held in one row. Empty tables give empty tables. Results called like a column of the table take its place; other
columns are handed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.urlfilter import fresh

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("unknown")), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(TAIL))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Runs of the rendered turns: array of (chars, train)."""

    def runs(turn: Column) -> Column:
        trained = F.coalesce(turn["role"] == TRAINED, F.lit(False))
        return F.array(F.struct(F.length(_header(turn)).alias("chars"), F.lit(False).alias("train")), F.struct(F.length(_body(turn)).alias("chars"), trained.alias("train")))

    return F.flatten(F.transform(turns, runs))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share; nulls are equal to each other."""
    same = F.zip_with(F.transform(a, lambda x: F.struct(x)), F.transform(b, lambda x: F.struct(x)), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


RESULTS = ("prefix_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def format_preferences(pairs: DataFrame, *, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Replace two columns of turns, array<struct<role, text>>, by prefix_turns, prompt, chosen, chosen_mask, rejected and rejected_mask."""
    empty = F.array().cast(pairs.schema[chosen_col].dataType)
    rest = [c for c in pairs.columns if c not in (chosen_col, rejected_col) and c.lower() not in RESULTS]
    a, b, n = fresh(rest, "turns_chosen", "turns_rejected", "turns_shared")
    given = pairs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{chosen_col}`"), empty).alias(a), F.coalesce(F.col(f"`{rejected_col}`"), empty).alias(b))
    cut = given.withColumn(n, common_prefix(F.col(a), F.col(b)))
    made = {"prefix_turns": F.col(n), "prompt": render(F.slice(a, F.lit(1), F.col(n)))}
    for side, turns in (("chosen", a), ("rejected", b)):
        after = F.when(F.size(turns) > F.col(n), F.slice(turns, F.col(n) + 1, F.size(turns))).otherwise(empty)
        made |= {side: render(after), f"{side}_mask": mask(after)}
    return cut.select(*[F.col(f"`{c}`") for c in rest], *[c.alias(name) for name, c in made.items()])


def mismatched_replies(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Preference pairs from plain conversations: (conv_id, chosen, rejected).

    Chosen is a conversation up to its last reply; rejected has the last reply of its neighbour (ids 2k and 2k + 1 are
    neighbours) in that place, a negative that answers something else. Without a neighbour's reply the rejected side
    ends before the reply; without a reply of its own both sides are the whole conversation. One shuffle, by the pair.
    """
    rows = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    number = F.expr("try_cast(conv_id AS bigint)")
    pair = F.coalesce(F.shiftright(number, 1).cast("string"), F.concat(F.lit("="), F.col("conv_id").cast("string")))
    pairs = rows.where("conv_id IS NOT NULL").groupBy(pair.alias("pair"))
    held = pairs.agg(F.sort_array(F.collect_set(F.struct("conv_id", "turn", "role", "text"))).alias("turns"))
    each = held.withColumn("conv_id", F.explode(F.array_distinct(F.col("turns.conv_id"))))
    own = F.filter("turns", lambda t: t["conv_id"] == F.col("conv_id"))
    replies = F.filter("turns", lambda t: (t["conv_id"] != F.col("conv_id")) & (t["role"] == TRAINED))
    plain = F.transform(own, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    last = F.array_max(F.transform(own, lambda t, i: F.when(t["role"] == TRAINED, i + 1).otherwise(0)))
    parted = each.select("conv_id", plain.alias("turns"), last.alias("last"), F.transform(F.slice(replies, F.greatest(F.size(replies), F.lit(1)), 1), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("reply"))
    chosen = F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns"))
    rejected = F.when(F.col("last") > 0, F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.col("reply"))).otherwise(F.col("turns"))
    return parted.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))
