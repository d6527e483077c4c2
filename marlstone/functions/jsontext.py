"""JSON inside model responses: extraction, and validation that keeps JSON's own types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICT_KEYS = ("is_tom", "unique_gold", "distractors_plausible", "overall_good")


def json_text(text: Column, greedy: bool = True) -> Column:
    """A fenced block's content, else what stands between braces, first to last or (not greedy) to the next; or null."""
    fenced = F.nullif(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}", 0), F.lit("")))


def parsed(text: Column, greedy: bool = True) -> Column:
    """The object in a response as a variant; null if it can't be parsed."""
    return F.try_parse_json(json_text(text, greedy))


def kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def verdict(text: Column) -> Column:
    """Struct of the four verdicts and the reason, if all four are JSON booleans; else null."""
    v = parsed(text)
    ok = F.lit(True)
    for k in VERDICT_KEYS:
        ok = ok & F.coalesce(kind(v, f"$.{k}") == "BOOLEAN", F.lit(False))
    return F.when(ok, F.struct(*(F.try_variant_get(v, f"$.{k}", "boolean").alias(k) for k in VERDICT_KEYS), F.coalesce(text_at(v, "$.reason"), F.lit("")).alias("reason")))


def mcq_object(text: Column) -> Column:
    """Struct of story, question, options A to D and answer, if all are there and the answer is one of the letters."""
    v = parsed(text)
    names = {"story": "$.story", "question": "$.question", **{f"opt_{c.lower()}": f"$.options.{c}" for c in "ABCD"}}
    answer = F.upper(F.trim(text_at(v, "$.answer")))
    ok = answer.isin(*"ABCD")
    for path in names.values():
        ok = ok & text_at(v, path).isNotNull()
    return F.when(ok, F.struct(*(text_at(v, p).alias(n) for n, p in names.items()), answer.alias("gold")))


def option_list_object(text: Column, n: int, subject: Column | None = None) -> Column:
    """Struct of story, question, options and gold letter, for n options without a blank and an index as gold."""
    v = parsed(text, greedy=False)
    options = F.try_variant_get(v, "$.options", "array<string>")
    gold = F.when(kind(v, "$.gold") == "BIGINT", F.try_variant_get(v, "$.gold", "int"))
    ok = (F.size(options) == n) & (gold >= 0) & (gold < n) & ~F.exists(options, lambda o: F.coalesce(F.trim(o), F.lit("")) == "")
    fill = lambda c: F.replace(c, F.lit("{subject}"), subject) if subject is not None else c
    return F.when(ok, F.struct(fill(text_at(v, "$.story")).alias("story"), fill(text_at(v, "$.question")).alias("question"), F.transform(options, fill).alias("options"), F.char(gold + 65).alias("gold")))


def flat_object(text: Column) -> Column:
    """Struct of story, question, opt_a to opt_d and gold, all present and not blank."""
    v = parsed(text)
    names = ("story", "question", "opt_a", "opt_b", "opt_c", "opt_d", "gold")
    ok = text_at(v, "$.gold").isin(*"ABCD")
    for n in names:
        ok = ok & (F.coalesce(F.trim(text_at(v, f"$.{n}")), F.lit("")) != "")
    return F.when(ok, F.struct(*(text_at(v, f"$.{n}").alias(n) for n in names)))


def translation_object(text: Column, gold: Column) -> Column:
    """A four-option object that kept its gold letter; else null."""
    o = mcq_object(text)
    return F.when(o["gold"] == gold, o)
