"""Keyword rules that grade a question's difficulty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.text import matches

# The patterns of each level, in natural order; ties between levels go to the earlier one.
RULES = {
    "easy": [
        r"\bhow many\b",
        r"\blist (all|the)\b",
        r"\bwhat is the (most|least|highest|lowest|cheapest|expensive)\b",
        r"\bwhich .{0,30} (are|is) from\b",
        r"\bcount\b",
        r"\bdistinct\b",
        r"\bshow (all|me)\b",
    ],
    "medium": [
        r"\btotal (revenue|spend|sales|cost|value)\b",
        r"\baverage\b",
        r"\beach (customer|product|category|country|order)\b",
        r"\bper (month|year|category|customer)\b",
        r"\bgroup\b",
        r"\bhow many orders did\b",
        r"\bsigned up\b",
        r"\bjoined\b",
        r"\bin 20\d\d\b",
    ],
    "hard": [
        r"\bnever\b",
        r"\bnot (in|placed|made|completed)\b",
        r"\bmore than (one|1|two|2)\b",
        r"\btop \d+.{0,30}(spend|revenue|value)\b",
        r"\bmonth.by.month\b",
        r"\bover time\b",
        r"\bfor each (country|region)\b",
        r"\bhaving\b",
        r"\banti.join\b",
        r"\bcompare.{0,20}(country|region|category)\b",
    ],
}
LEVELS = list(RULES)
NO_SIGNAL = "medium"


def level_score(question: Column, level: str) -> Column:
    """Number of the level's patterns found in an already lower-cased question."""
    return reduce(lambda a, b: a + b, [matches(question, question, p, "(?Ud)").cast("int") for p in RULES[level]])


def rule_grade(question: Column) -> Column:
    """``struct(difficulty, confidence)``; each pattern counts at most once for its level.

    The three scores are bound to one lambda variable, so every regular expression runs once per row however
    often the scores are used below.
    """

    def grade(s: Column) -> Column:
        ranked = F.sort_array(F.array(*[s[lv] for lv in LEVELS]), asc=False)
        total = s["easy"] + s["medium"] + s["hard"]
        winner = F.when(total == 0, F.lit(NO_SIGNAL))
        for lv in LEVELS:
            winner = winner.when(s[lv] == ranked[0], F.lit(lv))
        gap = F.when(total == 0, F.lit(0.0)).otherwise(F.bround((ranked[0] - ranked[1]) / total, 3))
        return F.struct(winner.alias("difficulty"), gap.alias("confidence"))

    bound = F.transform(F.array(F.lower(question)), lambda q: F.struct(*[level_score(q, lv).alias(lv) for lv in LEVELS]))
    return F.transform(bound, grade)[0]


def with_rule_grade(df: DataFrame, question: str = "question") -> DataFrame:
    graded = df.withColumn("_g", rule_grade(F.col(question)))
    return graded.withColumns({"difficulty": F.col("_g.difficulty"), "confidence": F.col("_g.confidence")}).drop("_g")
