"""Reward of a response: format, outcome and length window, as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.answers import boxed_letter


@dataclass(frozen=True)
class RewardParameters:
    l_min: float = 8.0
    l_max: float = 256.0
    l_max_short: float = 256.0
    l_max_long: float = 256.0
    k: float = 50.0
    aggregation: str = "multiplicative"
    w_format: float = 0.05
    w_outcome: float = 0.85
    w_length: float = 0.10

    def override(self, given: dict) -> RewardParameters:
        """Known keys replaced and cast to their type; unknown keys are ignored."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        return replace(self, **{k: kinds[k](v) for k, v in given.items() if k in kinds})

    def override_by(self, given: Column) -> Column:
        """The same for a map of strings in each row: a struct of the parameters."""
        kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
        return F.struct(*(F.coalesce(F.try_element_at(given, F.lit(f.name)).cast(kinds[type(v)]), F.lit(v)).alias(f.name) for f in fields(self) for v in [getattr(self, f.name)]))


def sigmoid(x: Column) -> Column:
    """Stable without branches: exp overflows to infinity, whose reciprocal is 0."""
    return F.lit(1.0) / (1 + F.exp(-x))


def length_window(n: Column, low: Column, high: Column, k: float) -> Column:
    span = F.greatest(F.lit(1), high - low)
    return sigmoid(k * (n - low) / span) * (1 - sigmoid(k * (n - high) / span))


def effective_l_max(source: Column, task: Column, p: RewardParameters) -> Column:
    source, task = F.lower(F.coalesce(source, F.lit(""))), F.coalesce(task, F.lit(""))
    return F.when(source.contains("direct"), p.l_max_short).when(source.contains("hitom") | task.startswith("order_"), p.l_max_long).otherwise(p.l_max)


def reward(response: Column, n_tokens: Column, truth: Column, l_max: Column, p: RewardParameters) -> Column:
    """Struct of r_fmt, r_out, r_len and r_total."""
    if p.aggregation not in ("multiplicative", "weighted_sum"):
        raise ValueError(f"unknown aggregation: {p.aggregation}")
    letter = boxed_letter(response)
    fmt = F.when(letter.isNotNull(), 1.0).otherwise(0.0)
    out = F.when(F.coalesce(letter == truth, F.lit(False)), 1.0).otherwise(0.0)
    window = length_window(n_tokens, F.lit(p.l_min), l_max, p.k)
    if p.aggregation == "multiplicative":
        total = fmt * out * window
    else:
        total = p.w_format * fmt + p.w_outcome * out + p.w_length * window
    return F.struct(fmt.alias("r_fmt"), out.alias("r_out"), window.alias("r_len"), total.alias("r_total"))
