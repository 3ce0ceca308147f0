"""Product profiles: shrunken aspect means, the price slice, the wide form, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.constants import AXES, EVIDENCE_MIN_CHARS, EVIDENCE_PER_PRODUCT, EVIDENCE_SEPARATOR, PUBLICATION_FLOOR
from aspectra.functions.scores import price_to_score


def cell_means(facts: DataFrame) -> DataFrame:
    """One row for each product and aspect: count, mean, variance, confidence."""
    return facts.groupBy("model_key", "aspect").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.var_samp("score").alias("var"), F.avg("confidence").alias("mean_confidence"))


def shrinkage_params(cells: DataFrame) -> DataFrame:
    """Empirical-Bayes parameters of each aspect over all products; k is null where the means don't vary beyond noise."""
    total = cells.groupBy("aspect").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand_mean"),
        F.avg("var").alias("within_var"),
        F.var_samp("mean").alias("observed_var"),
        F.avg("n").alias("mean_n"),
        F.count("*").alias("products"),
    )
    between = F.greatest(F.coalesce(F.col("observed_var") - F.col("within_var") / F.col("mean_n"), F.lit(0.0)), F.lit(0.0))
    return total.withColumn("between_var", between).withColumn("k", F.col("within_var") / F.when(F.col("between_var") > 0, F.col("between_var")))


def profiles_long(facts: DataFrame, floor: int = PUBLICATION_FLOOR) -> DataFrame:
    """Raw and shrunken mean of each product and aspect with ``floor`` mentions or more."""
    cells = cell_means(facts)
    params = shrinkage_params(cells).select("aspect", "grand_mean", "k")  # one row for each aspect
    shrunk = F.coalesce((F.col("n") * F.col("mean") + F.col("k") * F.col("grand_mean")) / (F.col("n") + F.col("k")), F.col("grand_mean"))
    return cells.where(F.col("n") >= floor).join(F.broadcast(params), "aspect").select("model_key", "aspect", shrunk.alias("score"), F.col("mean").alias("raw_score"), F.col("n").alias("mentions"), "mean_confidence")


def price_bounds(products: DataFrame) -> DataFrame:
    """5th and 95th percentile of the real products' positive prices; the extremes where these are equal."""
    p = F.percentile("price", F.array(F.lit(0.05), F.lit(0.95)))
    out = products.where("price > 0 and simulated = 0").agg(p.alias("p"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.count("*").alias("n"))
    wide = F.col("p")[0] < F.col("p")[1]
    return out.select(F.when(wide, F.col("p")[0]).otherwise(F.col("lo")).alias("cheapest"), F.when(wide, F.col("p")[1]).otherwise(F.col("hi")).alias("dearest"), "n")


def with_listed_price(profiles: DataFrame, products: DataFrame) -> DataFrame:
    """The price axis from listed prices in place of what reviews say of it."""
    bounds = price_bounds(products).select("cheapest", "dearest")  # one row
    score = price_to_score(F.col("price"), F.col("cheapest"), F.col("dearest"))
    listed = products.where("price > 0").crossJoin(F.broadcast(bounds)).select("model_key", F.lit("price").alias("aspect"), score.alias("score"), score.alias("raw_score"), F.col("reviews_total").alias("mentions"), F.lit(None).cast("double").alias("mean_confidence"))
    return profiles.where("aspect <> 'price'").unionByName(listed)


def profiles_wide(profiles: DataFrame) -> DataFrame:
    """A column for each axis, complete rows only. The axes are listed, so no pass finds them."""
    return profiles.groupBy("model_key").pivot("aspect", list(AXES)).agg(F.first("score")).dropna(subset=list(AXES))


def select_evidence(facts: DataFrame) -> DataFrame:
    """The lowest negative and highest positive sentences of each product and axis."""
    quota = max(1, EVIDENCE_PER_PRODUCT // 10)
    first = F.substring_index("evidence", EVIDENCE_SEPARATOR, 1)
    rows = facts.where(F.col("aspect").isin(*AXES) & F.col("evidence").isNotNull()).withColumn("sentence", first).where(F.length("sentence") >= EVIDENCE_MIN_CHARS)
    cell = Window.partitionBy("model_key", "aspect", "polarity")
    low = F.row_number().over(cell.orderBy("score", "review_id"))
    high = F.row_number().over(cell.orderBy(F.desc("score"), "review_id"))
    kept = rows.where("polarity <> 'neutral'").withColumn("_r", F.when(F.col("polarity") == "negative", low).otherwise(high))
    return kept.where(F.col("_r") <= quota).select("model_key", "aspect", "polarity", "score", "sentence")
