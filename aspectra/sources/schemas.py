"""Schemas of the inputs, and checks that give violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTINGS = "asin string, brand string, title string, url string, image string, price double"
REVIEWS = "asin string, name string, rating int, date string, verified boolean, title string, body string"
FACTS = "model_key string, review_id string, aspect string, polarity string, score double, confidence double, detection_confidence double, mentions int, p_negative double, p_neutral double, p_positive double, rating int, evidence string"
PAIRS = "review_id string, text string, aspect string, polarity string, label int, domain string, split string, terms string"
STORED = "id bigint, model_key string, text string, rating int, analysis string, created_utc string"

#: name: condition that every row meets.
FACT_RULES = {"score between 1 and 10": "score BETWEEN 1 AND 10", "probabilities sum to 1": "abs(p_negative + p_neutral + p_positive - 1) < 1e-3", "key present": "model_key IS NOT NULL AND review_id IS NOT NULL"}


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, n, example) of each rule that some row breaks, in one pass."""
    broken = F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    rows = df.select(F.explode(F.array_compact(broken)).alias("rule"), F.to_json(F.struct(*df.columns)).alias("row"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.min("row").alias("example"))


def parameters_in_range(**limits: tuple[float, float, float]) -> None:
    """ValueError for any (value, low, high) out of range: checked before a plan is built."""
    bad = {k: v for k, v in limits.items() if not v[1] <= v[0] <= v[2]}
    if bad:
        raise ValueError("; ".join(f"{k}={v} is not between {low} and {high}" for k, (v, low, high) in bad.items()))


def all_of(*conditions):  # noqa: ANN002, ANN201
    return reduce(lambda a, b: a & b, conditions)
