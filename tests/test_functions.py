import pytest
from pyspark.sql import functions as F

from marlstone.functions import answers, jsontext, prompts, reward, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("given,want", [
    ("first \\boxed{B}, later \\boxed{A}", "B"), ("\\boxed{Q}, so it must be C", "C"), ("Dogs", "D"), ("none here", None), ("", None), (None, None),
])
def test_extract_direct(spark, given, want):
    assert one(spark, answers.extract_direct(F.col("t")), t=given) == want


@pytest.mark.parametrize("given,want", [
    ("\\boxed{C} and \\boxed{D}", "D"), ("A" + "x" * 300, None), ("x" * 300 + "B then C.", "C"), (None, None),
])
def test_extract_cot(spark, given, want):
    assert one(spark, answers.extract_cot(F.col("t")), t=given) == want


@pytest.mark.parametrize("given,want", [(list("AABACABA"), "A"), (list("ABAB"), "A"), ([None, None], None), (["Z", "B"], "B"), ([], None)])
def test_vote(spark, given, want):
    assert one(spark, answers.vote(F.col("a")), a=given) == want


def test_number_of_options():
    for n in (1, 27):
        with pytest.raises(ValueError):
            answers.extractor(n)
    assert set(answers.extractor(5)) == {"direct", "cot", "vote"}


def test_gold_in_three_forms(spark):
    opts = ["red", "blue", "A"]
    for given, want in (("1", "B"), ("c", "C"), ("Blue ", "B"), ("7", None), ("green", None)):
        assert one(spark, answers.any_gold_letter(F.col("g"), F.col("o")), g=given, o=opts) == want


def test_json_keeps_its_types(spark):
    good = '```json\n{"is_tom": true, "unique_gold": true, "distractors_plausible": false, "overall_good": true}\n```'
    assert one(spark, jsontext.verdict(F.col("t"))["overall_good"], t=good) is True
    for bad in (good.replace("true}", '"true"}'), good.replace('"is_tom": true, ', ""), "garbage", "{broken", None):
        assert one(spark, jsontext.verdict(F.col("t")), t=bad) is None


def test_mcq_object(spark):
    t = 'Here: {"story": "s", "question": "q", "options": {"A": "1", "B": "2", "C": "3", "D": "4"}, "answer": " b "}'
    assert one(spark, jsontext.mcq_object(F.col("t"))["gold"], t=t) == "B"
    assert one(spark, jsontext.mcq_object(F.col("t")), t=t.replace('"D": "4"', '"E": "4"')) is None


@pytest.mark.parametrize("n,check", [(100.0, lambda x: x > 0.9), (2.0, lambda x: x < 0.25), (1000.0, lambda x: x < 0.1)])
def test_length_window(spark, n, check):
    assert check(one(spark, reward.length_window(F.col("n"), F.lit(8.0), F.lit(256.0), 50.0), n=n))


def test_reward(spark):
    p = reward.RewardParameters()
    full = one(spark, reward.reward(F.col("r"), F.lit(100.0), F.lit("B"), F.lit(256.0), p), r="\\boxed{B}")
    assert full["r_fmt"] == full["r_out"] == 1 and full["r_total"] == pytest.approx(full["r_len"])
    w = p.override({"aggregation": "weighted_sum", "l_max": "512", "other": 1})
    assert w.l_max == 512.0 and p.l_max == 256.0
    wrong = one(spark, reward.reward(F.col("r"), F.lit(100.0), F.lit("C"), F.lit(256.0), w), r="\\boxed{B}")
    assert wrong["r_total"] == pytest.approx(0.05 + 0.1 * wrong["r_len"])
    with pytest.raises(ValueError):
        reward.reward(F.col("r"), F.lit(1), F.lit("A"), F.lit(2), p.override({"aggregation": "sum"}))


@pytest.mark.parametrize("language", ["en", "zh"])
def test_prompt_round_trip(spark, language):
    made = prompts.user_prompt(F.col("s"), F.col("q"), F.col("o"), F.lit(language))
    got = one(spark, prompts.prompt_fields(made), s="Once. 从前。", q="Who?", o=["a", "b", "c", "d"])
    assert (got.story, got.question, got.options) == ("Once. 从前。", "Who?", ["a", "b", "c", "d"])
    assert one(spark, prompts.prompt_fields(F.col("t")), t="something else") is None


def test_text_functions(spark):
    assert one(spark, text.first_text(F.col("a"), F.col("b"), default="z"), a="NaN", b="  ") == "z"
    assert one(spark, text.rough_tokens(F.col("t")), t="a b 你好") == 4
    assert one(spark, text.strip_option_prefix(F.col("t")), t=" b：x") == "x"
    assert one(spark, text.split_choices(F.col("t")), t="A. x, y, B. z") == ["x, y", "z"]
    with pytest.raises(Exception, match="unknown protocol"):
        one(spark, text.sampling_parameters(F.col("p"), text.PROTOCOLS), p="other")
