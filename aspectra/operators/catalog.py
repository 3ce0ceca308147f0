"""From listings and reviews to catalogue products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.constants import MIN_REVIEWS, MIN_WORDS, REVIEW_CAP, SEED
from aspectra.sources.shared import written


def word_count(text: Column) -> Column:
    """White-space words; none in a blank text."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def usable_name(name: Column, brand: Column) -> Column:
    """Two tokens or more, and not just the brand."""
    return (F.size(F.split(F.trim(name), " ")) >= 2) & (F.lower(F.trim(name)) != F.lower(F.trim(brand)))


def attach_models(listings: DataFrame) -> DataFrame:
    return listings.withColumn("usable", usable_name(F.col("name"), F.col("brand")))


def with_models(reviews: DataFrame, listings: DataFrame) -> DataFrame:
    """Inner join on the listing's id; Spark chooses the side to send by its size."""
    return reviews.join(listings.select("asin", "model_key"), "asin")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by ``order``, so the choice is the same in every run."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("rn") <= n)


def strip_merged(products: DataFrame, prefix: str = "sim:") -> DataFrame:
    return products.where((F.coalesce("simulated", F.lit(0)) == 0) & ~F.startswith("model_key", F.lit(prefix)))


def sample_cap(df: DataFrame, key: str, id_: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each key, chosen by a hash."""
    order = F.md5(F.concat(F.col(id_).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return df.withColumn("_s", F.row_number().over(Window.partitionBy(key).orderBy(order, id_))).where(F.col("_s") <= cap).drop("_s")


def sample_n(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.col(id_).cast("string"), F.lit(f"|{seed}")).cast("binary")), id_).limit(n)


def running_total(df: DataFrame, order: list[Column | str], amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` up to and with each row in an order, without one task for all rows: sums by range, then within.

    Both parts must see the same ranges, whose bounds are sampled anew for each
    exchange of a plan: the dealt rows are a table of the shared folder.
    """
    ranged = written(df.repartitionByRange(*order).withColumns({"_p": F.spark_partition_id(), "_amount": amount}), "ranges")
    sums = ranged.groupBy("_p").agg(F.sum("_amount").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.sum("_amount").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_r", inside).join(F.broadcast(bases), "_p").withColumn(name, F.col("_base") + F.col("_r")).drop("_p", "_r", "_base", "_amount")


def enumerate_rows(df: DataFrame, order: str | list[Column], name: str) -> DataFrame:
    """Consecutive numbers in an order, from 1."""
    return running_total(df, [order] if isinstance(order, str) else order, F.lit(1).cast("long"), name)


def primary_listing(listings: DataFrame, reviews: DataFrame) -> DataFrame:
    """For each product the first non-null value of each column, listings with most reviews first."""
    counts = reviews.groupBy("asin").agg(F.count("*").alias("n"))
    counted = listings.join(counts, "asin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.col("n"), F.col("asin")))).alias(c)
    return counted.groupBy("model_key").agg(*(best(c) for c in ("asin", "name", "brand", "image")))


def build_candidates(listings: DataFrame, reviews: DataFrame, min_reviews: int = MIN_REVIEWS, cap: int = REVIEW_CAP, seed: int = SEED, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Products with enough reviews and a price, and a capped sample of their reviews."""
    listings = attach_models(listings).where("usable")
    long = with_models(reviews.where(word_count(F.col("body")) >= min_words), listings)
    kept = keep_first(long, ["model_key", "name", "body"], ["review_id"])
    counts = kept.groupBy("model_key").agg(F.count("*").alias("reviews_total"), F.avg("rating").alias("avg_rating")).where(F.col("reviews_total") >= min_reviews)
    priced = listings.where("price > 0").groupBy("model_key").agg(F.median("price").alias("price"), F.count("*").alias("listings"))
    products = counts.join(priced, "model_key").withColumn("reviews_sampled", F.least("reviews_total", F.lit(cap).cast("long")))
    return products, sample_cap(kept.join(products.select("model_key"), "model_key", "left_semi"), "model_key", "review_id", cap, seed)


def report(listings: DataFrame, reviews: DataFrame, min_reviews: int = MIN_REVIEWS, min_words: int = MIN_WORDS) -> DataFrame:
    """Counts of what each step drops, one row."""
    short = word_count(F.col("body")) < min_words
    base = reviews.agg(F.count("*").alias("reviews_in"), F.count_if(short).alias("too_short"))
    usable = attach_models(listings).where("usable")
    joined = with_models(reviews.where(~short), usable)
    # rows by key, then keys by model: one shuffle by key
    keys = joined.groupBy("model_key", "name", "body").agg(F.count("*").alias("n"))
    models = keys.groupBy("model_key").agg(F.sum(F.col("n") - 1).alias("extra"), F.count("*").alias("kept"))
    priced = usable.where("price > 0").select("model_key", F.lit(True).alias("priced")).distinct()
    flow = models.join(priced, "model_key", "left").agg(F.sum("extra").alias("duplicates"), F.count_if(F.col("kept") < min_reviews).alias("below_floor"), F.count_if((F.col("kept") >= min_reviews) & F.col("priced")).alias("products"))
    return base.crossJoin(F.broadcast(flow))
