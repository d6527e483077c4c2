"""Record layouts shared by sources, operators and tests."""

from __future__ import annotations

MCQ_RAW = "question_id string, source string, language string, task string, story string, question string, opt_a string, opt_b string, opt_c string, opt_d string, gold string"
MESSAGES = "array<struct<role: string, content: string>>"
TRAIN_CHAT = f"messages {MESSAGES}, ground_truth string, tag string, source string, language string, task string, question_id string"
EVAL_OPTIONS = "question_id string, source string, language string, task string, story string, question string, options array<string>, gold string"
RESULT = "question_id string, language string, task string, gold string, pred string, model string, protocol string, correct boolean, raw_responses array<string>"
RESULT_WIDE = RESULT + ", source string, category string, n_options int, benchmark string, finish_reason string, truncated boolean, has_boxed boolean, out_len bigint, answers array<string>"
SAMPLE = "question_id string, protocol string, sample_idx int, content string, prompt_tokens int, completion_tokens int"
REWARD_LABEL = "idx bigint, task string, language string, n_correct int, n_total int, reward_mean double, gold string"
VERDICT = "question_id string, is_tom boolean, unique_gold boolean, distractors_plausible boolean, overall_good boolean, reason string"
METRIC = "run string, step bigint, tag string, value double"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
