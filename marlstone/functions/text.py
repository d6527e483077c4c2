"""String and array functions: normalisation, parsing of prompts, counts, hashes and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_text(*columns: Column, default: str = "") -> Column:
    """The first column that is neither null, blank nor the word nan, trimmed."""
    kept = [F.when(~F.lower(F.trim(c.cast("string"))).isin("", "nan"), F.trim(c.cast("string"))) for c in columns]
    return F.coalesce(*kept, F.lit(default))


def split_choices(text: Column) -> Column:
    """Choices of ``A. x, B. y``: cut before each letter, which is removed."""
    parts = F.split(text, r",\s*(?=[A-Z]\.\s)")
    return F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*[A-Z]\.\s*", "")))


def strip_option_prefix(text: Column) -> Column:
    """An option without a letter from A to D and its separator that were baked into it."""
    return F.regexp_replace(text, r"^\s*[A-Da-d][.．、:：]\s*", "")


def strip_trailing_parenthesis(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")


def strip_articles(text: Column) -> Column:
    """Lower-cased and trimmed, without ``the``, ``a`` and ``an`` in front, tried once each in that order."""
    out = F.lower(F.trim(text))
    for article in ("the", "a", "an"):
        out = F.regexp_replace(out, f"^{article} ", "")
    return out


def before_marker(text: Column, marker: str) -> Column:
    """What stands before the first marker; everything if it doesn't occur."""
    return F.substring_index(text, marker, 1)


def truncate(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(tail))).otherwise(text)


def rough_tokens(text: Column) -> Column:
    """White space characters plus one, plus half of the CJK characters; empty or null is 0."""
    n = F.regexp_count(text, F.lit(r"\s")) + 1 + F.floor(F.regexp_count(text, F.lit("[\\u3000-\\u9FFF]")) / 2)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(n).cast("long")


def sentence_count(text: Column) -> Column:
    """Sentence ends of two scripts, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.。！!]")))


def step_lines(text: Column) -> Column:
    """Lines that start with a step marker."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.ltrim(line).rlike("^(Step|步骤)")))


def text_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def cache_key(*parts: Column) -> Column:
    """Parts joined by ``__``, with slashes and colons replaced so that the key can name a file."""
    safe = [F.replace(F.replace(p.cast("string"), F.lit("/"), F.lit("_")), F.lit(":"), F.lit("_")) for p in parts]
    return F.concat_ws("__", *safe)


def wrap_think(reasoning: Column, content: Column) -> Column:
    """The content behind its reasoning in a think block, if there is any."""
    return F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n"), content)).otherwise(content)


def non_pad_count(ids: Column, pad: int = 0) -> Column:
    return F.size(F.filter(ids, lambda x: x != pad))


def question_type(question: Column, answer: Column) -> Column:
    """yes_no, knowledge or container, by the words of a question and its answer; the first that fits."""
    q, a = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    asks = q.contains("knows about") | q.contains("know about") | q.contains("know it") | a.contains("know about it") | a.contains("know it")
    return F.when(q.contains("yes or no") | a.isin("yes", "no"), "yes_no").when(asks, "knowledge").otherwise("container")


def rule_distractors(kind: Column, gold: Column) -> Column:
    """Wrong answers that a question's type gives: the opposite and two hedges; null for containers."""
    g = F.lower(F.trim(gold))
    knows = g.contains("does not") | g.contains("doesn't") | g.contains("not know")
    yes_no = F.array(F.when(g == "yes", "no").otherwise("yes"), F.lit("I don't know"), F.lit("It's unclear from the story"))
    knowledge = F.array(F.when(knows, "knows about it").otherwise("does not know about it"), F.lit("I don't know"), F.lit("It depends on context"))
    return F.when(kind == "yes_no", yes_no).when(kind == "knowledge", knowledge)


def tuple_items(text: Column) -> Column:
    """The quoted items of a tuple literal; null if the text isn't one."""
    items = F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))
    return F.when(text.rlike(r"^\s*\(.*\)\s*$"), items)


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", F.bround(x * 100, 2))


def signed_points(x: Column) -> Column:
    """A difference of rates in percentage points, with its sign."""
    return F.format_string("%+.2f", F.bround(x * 100, 2))


def sampling_parameters(protocol: Column, table: dict[str, dict]) -> Column:
    """Struct of (max_tokens, temperature, top_p, n) of a protocol; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown protocol: "), F.coalesce(protocol, F.lit("null")))).cast("struct<max_tokens: int, temperature: double, top_p: double, n: int>")
    for name, p in table.items():
        one = F.struct(F.lit(p["max_tokens"]).alias("max_tokens"), F.lit(float(p["temperature"])).alias("temperature"), F.lit(float(p["top_p"])).alias("top_p"), F.lit(p["n"]).alias("n"))
        out = F.when(protocol == name, one).otherwise(out)
    return out


#: Sampling parameters of the evaluation protocols.
PROTOCOLS = {
    "direct": {"max_tokens": 64, "temperature": 0.0, "top_p": 1.0, "n": 1},
    "direct_think": {"max_tokens": 8192, "temperature": 0.0, "top_p": 1.0, "n": 1},
    "cot": {"max_tokens": 8192, "temperature": 0.6, "top_p": 0.95, "n": 1},
    "del_tom": {"max_tokens": 8192, "temperature": 0.7, "top_p": 0.95, "n": 8},
}


def interpolate(a: Column, b: Column, alpha: float) -> Column:
    """Element-wise (1 - alpha) a + alpha b of two arrays of one length."""
    return F.zip_with(a, b, lambda x, y: (1 - alpha) * x.cast("double") + alpha * y.cast("double"))
