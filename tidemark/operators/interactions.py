"""Product and ratio features of a matrix, declared as rules and evaluated by one function.

A rule pairs a left column with every column that a pattern matches, and names the result after the
match. Columns that a matrix does not have make no feature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import LABELS

_LABEL = "(" + "|".join(LABELS.values()) + ")"
#: Kept from a ratio with a rate of 0.
_GUARD = 1e-6


@dataclass(frozen=True)
class Rule:
    """``left`` and ``result`` may use the groups of the pattern ``right``, as regular expression templates do."""

    left: str
    right: str
    result: str
    ratio: bool = False
    absent_left: float | None = None

    def features(self, columns: list[str]) -> dict[str, Column]:
        out = {}
        for found in filter(None, (re.fullmatch(self.right, c) for c in sorted(columns))):
            left = found.expand(self.left)
            if left not in columns and self.absent_left is None:
                continue
            a = F.col(left) if left in columns else F.lit(self.absent_left)
            b = F.col(found[0])
            out[found.expand(self.result)] = a / (b + _GUARD) if self.ratio else a * b
        return out


#: For trees: topic x group rate, topic count x person rate, history x recency, trainer x category.
TREE_RULES = [
    Rule("has_topic_trained_on", rf"group_{_LABEL}_rate", r"has_topic_x_group_\1_rate"),
    Rule("has_topic_trained_on", rf"group_{_LABEL}_rate_smoothed", r"has_topic_x_group_\1_rate"),
    Rule("topic_count", rf"prior_{_LABEL}_rate", r"topic_count_x_prior_\1_rate"),
    Rule("has_prior_history", "days_since_last_training", "has_prior_x_days_since"),
    Rule("trainer_encoded", r"topic_cat_(.*)", r"trainer_x_topic_\1"),
]
#: For linear models: topic and visits x person rate, cooperative x group rates, person over county rate.
LINEAR_RULES = [
    Rule("has_topic_trained_on", rf"prior_{_LABEL}_rate", r"topic_x_prior_\1_rate", absent_left=0),
    Rule("prior_training_count", rf"prior_{_LABEL}_rate", r"count_x_prior_\1_rate"),
    Rule("belong_to_cooperative", r".*group_.*_rate.*", r"coop_x_\g<0>"),
    Rule(r"prior_adopted_within_\1_rate", r"county_adopted_within_(.*)_rate", r"farmer_vs_county_\1", ratio=True),
]


def apply(matrix: DataFrame, rules: list[Rule]) -> DataFrame:
    """The matrix with the features of all rules; of equal names the first rule's counts."""
    new: dict[str, Column] = {}
    for rule in rules:
        new = {**rule.features(matrix.columns), **new}
    return matrix.withColumns(new) if new else matrix


def interactions(matrix: DataFrame) -> DataFrame:
    return apply(matrix, TREE_RULES)


def linear_interactions(matrix: DataFrame) -> DataFrame:
    return apply(matrix, LINEAR_RULES)
