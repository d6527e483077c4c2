"""Answer letters in model responses, votes over samples, and letters for given answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.schemas import LETTERS

#: How many characters at the end of a response the fallback of extract_cot reads.
TAIL = 200


def _letters(n: int) -> str:
    if not 2 <= n <= 26:
        raise ValueError(f"between 2 and 26 options are possible, not {n}")
    return f"[A-{LETTERS[n - 1]}]"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract_direct(text: Column, n: int = 4, strict: bool = False) -> Column:
    """The first boxed letter; else the first of the n letters anywhere, inside words too unless strict."""
    one = _letters(n)
    bare = rf"\b({one})\b" if strict else f"({one})"
    return F.coalesce(_or_null(F.regexp_extract(text, rf"\\boxed\{{({one})\}}", 1)), _or_null(F.regexp_extract(text, bare, 1)))


def extract_cot(text: Column, n: int = 4) -> Column:
    """The last boxed letter; else the last of the n letters in the final TAIL characters."""
    one = _letters(n)
    boxed = F.regexp_extract_all(text, F.lit(rf"\\boxed\{{({one})\}}"), F.lit(1))
    tail = F.when(F.length(text) > TAIL, F.substring(text, -TAIL, TAIL)).otherwise(text)
    bare = F.regexp_extract_all(tail, F.lit(f"({one})"), F.lit(1))
    return F.coalesce(F.try_element_at(boxed, F.lit(-1)), F.try_element_at(bare, F.lit(-1)))


def extractor(n: int) -> dict[str, object]:
    """The three protocols' extractors for n options; another n than 2 to 26 is an error."""
    _letters(n)
    return {"direct": lambda t: extract_direct(t, n), "cot": lambda t: extract_cot(t, n), "vote": lambda ts: vote(F.transform(ts, lambda t: extract_cot(t, n)), n)}


def extract_for_options(text: Column, n_options: Column, most: int = 26) -> Column:
    """extract_direct with each row's own number of options, as one branch for each number."""
    out = F.lit(None).cast("string")
    for n in range(most, 1, -1):
        out = F.when(n_options == n, extract_direct(text, n)).otherwise(out)
    return out


def vote(answers: Column, n: int = 4) -> Column:
    """The most frequent valid letter of an array, ties by the alphabet; null without one."""
    valid = F.filter(answers, lambda a: a.isin(*LETTERS[:n]))
    tally = F.transform(F.array_distinct(valid), lambda a: F.struct((-F.size(F.filter(valid, lambda b: b == a))).alias("n"), a.alias("a")))
    return F.array_min(tally)["a"]


def bounded_letter(text: Column) -> Column:
    """The first A, B, C or D that stands as a word."""
    return _or_null(F.regexp_extract(text, r"\b([ABCD])\b", 1))


def boxed_letter(text: Column) -> Column:
    """The first boxed letter of the whole alphabet."""
    return _or_null(F.regexp_extract(text, r"\\boxed\{([A-Z])\}", 1))


def has_boxed(text: Column, n: int = 4) -> Column:
    return F.coalesce(text.rlike(rf"\\boxed\{{{_letters(n)}\}}"), F.lit(False))


def answer_letter(answer: Column, options: Column) -> Column:
    """Letter of the first option equal to the answer, without case and outer blanks; null if none."""
    at = F.array_position(F.transform(options, lambda o: F.lower(F.trim(o))), F.lower(F.trim(answer)))
    return F.when(at > 0, F.char(at.cast("int") + 64))


def label_letter(label: Column, options: Column) -> Column:
    """Letter of the option that equals the trimmed label; only then without case."""
    exact = F.array_position(F.transform(options, lambda o: F.trim(o)), F.trim(label))
    return F.coalesce(F.when(exact > 0, F.char(exact.cast("int") + 64)), answer_letter(label, options))


def any_gold_letter(gold: Column, options: Column) -> Column:
    """Letter of a gold that is an index from 0, a letter, or an option's text."""
    index = gold.try_cast("int")
    by_index = F.when((index >= 0) & (index < F.size(options)), F.char(index + 65))
    letter = F.upper(F.trim(gold))
    place = F.instr(F.lit(LETTERS), letter)
    by_letter = F.when((F.length(letter) == 1) & (place > 0) & (place <= F.size(options)), letter)
    return F.coalesce(by_index, by_letter, answer_letter(gold, options))


def numbered_letter(label: Column) -> Column:
    """Letter of a label that counts from 1; null if it isn't a number of the alphabet."""
    n = label.try_cast("int")
    return F.when((n >= 1) & (n <= 26), F.char(n + 64))
