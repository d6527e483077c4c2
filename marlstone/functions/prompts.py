"""Prompts, chat messages and their way back to fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the parts of a prompt.
LABELS = {"en": ("Story:\n", "Question: "), "zh": ("故事：\n", "问题：")}
SYSTEM_DIRECT = "Read the story and answer the question. Reply with one letter of {letters} as \\boxed{{X}} and nothing else."
SYSTEM_COT = "Read the story, reason step by step, and end with one letter of {letters} as \\boxed{{X}}."
SYSTEM_DELTA = "Read the story. After each event write who noticed it and whose belief it changes, then answer from these changes alone. End with one letter of {letters} as \\boxed{{X}}."
SYSTEM_SFT = {"en": "Reason inside <reasoning> tags in numbered steps, then answer as \\boxed{X}.", "zh": "请在 <reasoning> 标签内分步推理，然后以 \\boxed{X} 作答。"}


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(" \n\r\t\u000b\f"))


def option_lines(options: Column) -> Column:
    """``A. first`` and so on, one option a line."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), F.coalesce(o, F.lit("")))), "\n")


def user_prompt(story: Column, question: Column, options: Column, language: Column, keep_empty_story: bool = False) -> Column:
    """Story, question and options; the story's part is left out if it is empty, unless that is to be kept."""
    def one(key: str) -> Column:
        head, ask = LABELS[key]
        block = F.concat(F.lit(head), F.coalesce(story, F.lit("")), F.lit("\n\n"))
        if not keep_empty_story:
            block = F.when(F.coalesce(story, F.lit("")) == "", "").otherwise(block)
        return F.concat(block, F.lit(ask), F.coalesce(question, F.lit("")), F.lit("\n"), option_lines(options))

    return F.when(language == "zh", one("zh")).otherwise(one("en"))


def letter_list(n: Column) -> Column:
    """``A, B, C`` for n options."""
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(i + 65)), ", ")


def system_prompt(n: Column, template: str = SYSTEM_DIRECT) -> Column:
    before, after = (x.replace("{{", "{").replace("}}", "}") for x in template.split("{letters}"))
    return F.concat(F.lit(before), letter_list(n), F.lit(after))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def first_of_role(messages: Column, role: str) -> Column:
    """Content of the first message of a role; empty if there is none."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def conversation_key(messages: Column) -> Column:
    """All roles and contents as one text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("::"), m["content"])), "|||")


def sft_response(reasoning: Column, final: Column) -> Column:
    return F.concat(F.lit("<reasoning>\n"), reasoning, F.lit("\n</reasoning>\n\n"), final)


def sft_system(language: Column) -> Column:
    return F.when(language == "zh", SYSTEM_SFT["zh"]).otherwise(SYSTEM_SFT["en"])


def trace_parts(text: Column) -> Column:
    """Struct of the reasoning and answer blocks, null where one is missing."""
    part = lambda tag: F.nullif(strip(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    return F.struct(part("reasoning").alias("reasoning"), part("answer").alias("answer"))


def prompt_letters(prompt: Column) -> Column:
    """How many option lines a prompt has."""
    return F.regexp_count(prompt, F.lit("\\n[A-Z]\\.\\s"))


def prompt_fields(prompt: Column) -> Column:
    """Struct of story, question and options of a rendered prompt in either language; null for another shape."""
    def one(key: str) -> Column:
        head, ask = (x.strip() for x in LABELS[key])
        rest = F.substring_index(prompt, f"\n{ask}", -1)
        lines = F.filter(F.split(rest, "\n"), lambda x: x.rlike(r"^[A-Z]\.\s"))
        return F.struct(
            strip(F.regexp_replace(F.substring_index(prompt, f"\n{ask}", 1), f"^{head}\\n?", "")).alias("story"), strip(F.substring_index(rest, "\n", 1)).alias("question"),
            F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[A-Z]\.\s*", ""))).alias("options"),
        )

    fits = lambda key: prompt.contains("\n" + LABELS[key][1].strip()) & prompt.startswith(LABELS[key][0].strip())
    return F.when(fits("en"), one("en")).when(fits("zh"), one("zh"))


def prompt_fields_strict(prompt: Column) -> Column:
    """The same for English prompts of exactly four options, by one pattern; null for another shape."""
    pattern = r"(?s)^Story:\n(.*?)\n\nQuestion:\s*(.*?)\nA\.\s*(.+?)\nB\.\s*(.+?)\nC\.\s*(.+?)\nD\.\s*(.+?)$"
    get = lambda i: F.regexp_extract(prompt, pattern, i)
    return F.when(prompt.rlike(pattern), F.struct(*(get(i + 1).alias(n) for i, n in enumerate(("story", "question", "opt_a", "opt_b", "opt_c", "opt_d")))))
