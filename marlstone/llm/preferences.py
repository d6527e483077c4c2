"""Preference formatting: the longest common turn prefix as prompt, and two masked completions.

Turns are compared by role and text, null-safe, position by position.  The common prefix is rendered once.  What follows
in either conversation is its completion; only the texts of ``train_roles`` in it are trained on, given as spans
(start, length) in characters of the completion.  All in DataFrame functions: a grouped list of turns per conversation,
which is as long as the conversation, and one join on the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turns(conv: DataFrame, name: str) -> DataFrame:
    turn = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return conv.groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def _spans(turns: Column, train_roles: tuple[str, ...]) -> Column:
    """Spans of trained text, from a fold that carries the position."""
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        size, head = F.length(F.coalesce(t["text"], F.lit(""))), F.length(_head(t))
        one = F.struct((acc["at"] + head).alias("start"), size.alias("length"))
        keep = t["role"].isin(*train_roles) & (size > 0)
        return F.struct((acc["at"] + head + size + 1).alias("at"), F.when(keep, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """pair_id, n_common, prompt, chosen, chosen_spans, rejected, rejected_spans for pairs that have both sides.

    chosen, rejected: pair_id, turn, role, text; other columns are ignored.  Turns are in the order of turn, then role,
    then text; repeated rows are turns of their own.  A null role or text is rendered as empty and equals only null.  If
    one side is a prefix of the other its completion is empty.  A pair with one side only, or a null id, gives no row.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id")
    least = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"]))
    first = F.array_position(same, False).cast("int")
    both = both.withColumn("n_common", F.when(first > 0, first - 1).otherwise(least))
    rest = {x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0))) for x in "cr"}
    both = both.select("pair_id", "n_common", F.slice("c", 1, F.col("n_common")).alias("p"), rest["c"].alias("c"), rest["r"].alias("r"))
    return both.select(
        "pair_id", "n_common", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _spans(F.col("c"), train_roles).alias("chosen_spans"),
        _render(F.col("r")).alias("rejected"), _spans(F.col("r"), train_roles).alias("rejected_spans"),
    )


def swapped_answers(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs made of one table of conversations (conv_id, turn, role, text): each conversation is chosen; rejected is the
    same with the last answer's text taken from the conversation whose id follows (none: empty).

    A conversation without an answer is its own rejected side, so both completions are empty.  Of several answers in the
    last turn that has one, each text is replaced, and the greatest (null first) is the one that is passed on.
    """
    last = conv.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("answer"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.coalesce("answer", F.lit("")).alias("other"))
    rows = conv.join(last.select("conv_id", "last").join(other, "conv_id", "left"), "conv_id", "left")
    swap = rows.withColumn("text", F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.coalesce("other", F.lit(""))).otherwise(F.col("text")))
    return tuple(x.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text") for x in (conv, swap))


def spans_as_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["length"].cast("string"))), ",")
