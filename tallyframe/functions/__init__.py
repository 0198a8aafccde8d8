from tallyframe.functions.bins import age_breaks, cut, cut_id, cut_labels
from tallyframe.functions.nulls import (
    floor_at_one, if_else, in_set, not_in_set, ratio, strict_mean, strict_sum, sum0, weighted_mean,
)
from tallyframe.functions.numbers import flag, percent_text, round_half_even

__all__ = [
    "age_breaks", "cut", "cut_id", "cut_labels", "flag", "floor_at_one", "if_else", "in_set",
    "not_in_set", "percent_text", "ratio", "round_half_even", "strict_mean", "strict_sum", "sum0",
    "weighted_mean",
]
