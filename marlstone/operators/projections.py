"""Projections: unpivots, mappings, renders and conversions of question tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import prompts

#: Abilities with a task of their own, and ordered prefixes of the others.
ABILITIES = {
    "Belief: Location false beliefs": "False Belief",
    "Belief: Content false beliefs": "False Belief",
    "Belief: Sequence false beliefs": "False Belief",
    "Belief: Identity false beliefs": "False Belief",
    "Belief: Location false beliefs Belief: Second-order beliefs": "False Belief",
    "Belief: Content false beliefs Belief: Second-order beliefs": "False Belief",
}
PREFIXES = (
    ("Belief", "Belief"), ("Desire", "Desire"), ("Emotion", "Emotion"), ("Intention", "Intention"), ("Knowledge", "Knowledge"),
    ("Non-Literal Communication", "Non-literal Comm"), ("Non-literal communication", "Non-literal Comm"), ("Non-literal Comm", "Non-literal Comm"),
)


def category(value: Column, exact: dict[str, str], prefixes: tuple[tuple[str, str], ...], default: str = "Other") -> Column:
    """The exact entry, else that of the first prefix followed by a colon or blank, else the default."""
    v, out = F.trim(value), F.lit(default)
    for prefix, name in reversed(prefixes):
        out = F.when(v.startswith(prefix + ":") | v.startswith(prefix + " "), name).otherwise(out)
    for key, name in exact.items():
        out = F.when(v == key, name).otherwise(out)
    return out


def belief_label(order: Column, first_false: Column, both_false: Column) -> Column:
    """A task from a question's order and two flags that are the string TRUE or something else."""
    label = lambda flag: F.when(F.coalesce(flag == "TRUE", F.lit(False)), "False Belief").otherwise("Belief")
    return F.when(order == "-1", "Knowledge").when(order == "1", label(first_false)).when(order == "2", label(both_false)).otherwise("Belief")


def unpivot_languages(rows: DataFrame, fields: tuple[str, ...], languages: tuple[str, ...] = ("en", "zh"), needed: tuple[str, ...] = (), letters: str = "ABCD") -> DataFrame:
    """A row for each language whose needed fields (column ``field_language``) aren't empty; the gold must be a letter."""
    keep = [c for c in rows.columns if not any(c == f"{f}_{x}" for f in fields for x in languages)]
    one = [F.struct(F.lit(x).alias("language"), *(F.trim(F.coalesce(f"{f}_{x}", F.lit(""))).alias(f) for f in fields)) for x in languages]
    out = rows.where(F.col("gold").isin(*letters)).select(*keep, F.explode(F.array(*one)).alias("r")).select(*keep, "r.*")
    for f in needed:
        out = out.where(F.col(f) != "")
    return out


def split_subtasks(rows: DataFrame, subtasks: dict[str, dict[str, Column]]) -> DataFrame:
    """Each row once for each subtask, with that subtask's columns."""
    one = [F.struct(F.lit(name).alias("subtask"), *(c.alias(k) for k, c in cols.items())) for name, cols in subtasks.items()]
    made = {k for cols in subtasks.values() for k in cols}
    keep = [c for c in rows.columns if c not in made]
    return rows.select(*keep, F.explode(F.array(*one)).alias("r")).select(*keep, "r.*")


def ordinal_id(prefix: str, n: Column, width: int = 6) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def to_chat(rows: DataFrame, template: str = prompts.SYSTEM_DIRECT, tag: str = "mcq") -> DataFrame:
    """Question rows as chat rows, in the train layout; the tag is always set, since rows without one get lost later."""
    opts = F.array("opt_a", "opt_b", "opt_c", "opt_d")
    user = prompts.user_prompt(F.col("story"), F.col("question"), opts, F.col("language"), keep_empty_story=True)
    return rows.select(prompts.chat(prompts.system_prompt(F.lit(4), template), user).alias("messages"), F.col("gold").alias("ground_truth"), F.lit(tag).alias("tag"), "source", "language", "task", "question_id")


def to_chat_options(rows: DataFrame, template: str = prompts.SYSTEM_DIRECT, tag: str = "mcq") -> DataFrame:
    """The same for any number of options; a row that has messages already keeps them."""
    made = prompts.chat(prompts.system_prompt(F.size("options"), template), prompts.user_prompt(F.col("story"), F.col("question"), F.col("options"), F.col("language")))
    messages = F.coalesce(F.col("messages"), made) if "messages" in rows.columns else made
    return rows.select(messages.alias("messages"), F.col("gold").alias("ground_truth"), F.lit(tag).alias("tag"), "source", "language", "task", "question_id")


def to_sft(rows: DataFrame) -> DataFrame:
    """Reasoning traces (story, question, options, reasoning, final, ...) as supervised rows."""
    user = prompts.user_prompt(F.col("story"), F.col("question"), F.col("options"), F.col("language"), keep_empty_story=True)
    return rows.select(prompts.sft_system(F.col("language")).alias("system"), user.alias("prompt"), prompts.sft_response(F.col("reasoning"), F.col("final")).alias("response"), "question_id", "language", "task", F.coalesce("source", F.lit("")).alias("source"))


def style_variant(rows: DataFrame, template: str, source: str, suffix: str) -> DataFrame:
    """Copies of chat rows with another system prompt, for the letters that the user's prompt has, under new ids."""
    user = prompts.first_of_role(F.col("messages"), "user")
    messages = prompts.chat(prompts.system_prompt(F.greatest(F.lit(1), prompts.prompt_letters(user)), template), user)
    return rows.withColumn("messages", messages).withColumn("source", F.lit(source)).withColumn("question_id", F.concat("question_id", F.lit(suffix)))


def match_text(*columns: Column, blank_nulls: bool = False) -> Column:
    """Columns as one text: nulls skipped and joined by blanks, or as empty and run together."""
    return F.concat(*(F.coalesce(c, F.lit("")) for c in columns)) if blank_nulls else F.concat_ws(" ", *columns)


def drop_private(rows: DataFrame) -> DataFrame:
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def retag(rows: DataFrame, tag: str) -> tuple[DataFrame, Column]:
    """Rows with a constant tag, and an aggregate that counts those which had another."""
    return rows.withColumn("tag", F.lit(tag)), F.count_if(~F.col("tag").eqNullSafe(tag)).alias("changed")


def relabel(rows: DataFrame, fresh: DataFrame, key: str = "question_id", column: str = "task") -> DataFrame:
    """Rows with the column from fresh (key, column) where that has one, and whether it changed."""
    new = fresh.select(key, F.col(column).alias("__new"))
    out = rows.join(new, key, "left").withColumn("changed", F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column)))
    return out.withColumn(column, F.coalesce("__new", column)).drop("__new")


def fill_options(rows: DataFrame, defaults: dict[str, tuple[str, ...]]) -> DataFrame:
    """All four options from the language's defaults where any of them is blank."""
    names = ("opt_a", "opt_b", "opt_c", "opt_d")
    blank = F.lit(False)
    for n in names:
        blank = blank | (F.trim(F.coalesce(n, F.lit(""))) == "")
    fill = {n: F.element_at(F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), F.lit(v[i])))), F.col("language")) for i, n in enumerate(names)}
    return rows.withColumns({n: F.when(blank, F.coalesce(fill[n], F.col(n))).otherwise(F.col(n)) for n in names})
