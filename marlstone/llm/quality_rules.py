"""Quality rules: a table of thresholds compiled into one projection of Spark SQL functions.

Per text: words are maximal runs outside ``\\x20 \\x09-\\x0D``.  ``word_chars`` counts code points in words, ``n_symbols``
the characters of ``[#*$%&|<>]``, ``n_dup_lines`` the lines with a word that equal an earlier line, ``n_repeat_words``
the words inside 3-word windows that occur twice or more in the text.  Null text has no words.  Any division by zero
words or lines counts as 0.  The measures of one text come from its own row only, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = " \\t\\n\\u000B\\u000C\\r"
_SPLIT = "[\\\\x20\\\\x09-\\\\x0D]+"

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "with", "as", "by", "at", "be", "this", "are", "was", "an", "or", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "est", "pour", "dans", "par", "sur", "au", "avec",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "dem", "ein", "eine", "im", "mit", "auf", "als", "nicht", "sich", "für",
    "el", "los", "las", "y", "del", "se", "con", "por", "una", "para", "su", "al", "es",
)


@dataclass(frozen=True)
class Rule:
    """A measure as SQL over the counts, and the closed range that a text must be in."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: A text fails the base if it has few words, or if most of them stand in repeated 3-word windows.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
RULES = (
    Rule("mean_word_length", "word_chars / n_words", low=2, high=15),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.15),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("stop_word_ratio", "n_stop_words / n_words", low=0.02),
    Rule("upper_case_ratio", "n_upper / word_chars", high=0.4),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", high=0.5),
)


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is evaluated once for each row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _repeat_words(ws: str) -> str:
    grams = f"sort_array(transform(sequence(0, size({ws}) - 3), i -> struct(xxhash64({ws}[i], {ws}[i + 1], {ws}[i + 2]) AS h, i AS i)))"
    twice = "sort_array(filter(transform(s, (e, k) -> CASE WHEN get(s, k - 1).h = e.h OR get(s, k + 1).h = e.h THEN e.i ELSE -1 END), x -> x >= 0))"
    covered = "aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (t, x) -> t + x)"
    return f"CASE WHEN size({ws}) < 4 THEN 0L ELSE {_let(grams, 's', _let(twice, 'p', covered))} END"


def measures(text: str) -> Column:
    """An array of one struct with the counts of the SQL expression text, to be inlined."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    counts = {
        "n_words": "CAST(size(ws) AS BIGINT)",
        "word_chars": "CAST(char_length(array_join(ws, '')) AS BIGINT)",
        "n_symbols": "CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT)",
        "n_dup_lines": _let(f"filter(split(t, '\\n'), l -> btrim(l, '{_WS}') <> '')", "ls", "CAST(size(ls) - size(array_distinct(ls)) AS BIGINT)"),
        "n_lines": f"CAST(size(filter(split(t, '\\n'), l -> btrim(l, '{_WS}') <> '')) AS BIGINT)",
        "n_repeat_words": _repeat_words("ws"),
        "n_stop_words": f"CAST(size(filter(ws, w -> lower(w) IN ({stop}))) AS BIGINT)",
        "n_upper": "CAST(regexp_count(t, '[A-Z]') AS BIGINT)",
    }
    fields = ", ".join(f"{sql} AS {name}" for name, sql in counts.items())
    words = f"CASE WHEN btrim(t, '{_WS}') = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(btrim(t, '{_WS}'), '{_SPLIT}') END"
    inner = _let(words, "ws", f"struct({fields})")
    return F.expr(f"transform(array(coalesce(CAST({text} AS STRING), '')), t -> {inner})")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """Whether all rules hold, as one boolean expression over the counts."""
    held = F.lit(True)
    for r in rules:
        m = F.coalesce(F.try_divide(*(F.expr(x) for x in r.measure.split(" / "))) if " / " in r.measure else F.expr(r.measure), F.lit(0))
        if r.low is not None:
            held = held & (m >= r.low)
        if r.high is not None:
            held = held & (m <= r.high)
    return held


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words", "n_upper")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' doc_id with the counts, base_failed and kept; one row for each input row, repeated ids included."""
    counted = docs.select("doc_id", F.inline(measures("text")).alias(*COUNTS))
    return counted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs as they are, whatever their names."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    counted = docs.select(own, F.col("text").alias("__text")).select("__row", F.inline(measures("__text")).alias(*COUNTS))
    kept = counted.where(~F.expr(BASE_FAILED) & compile_rules(rules))
    return kept.select("__row.*")
