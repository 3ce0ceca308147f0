"""Annotated text to a labelled, leak-free dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.constants import SPLIT_PRIORITY, VOTE_ORDER

# How raw categories map to aspects.
DROP = ("Product Accessories", "OPTICAL_DRIVES", "Out_Of_Scope")
OVERRIDES = {"PRICE": "price"}
WHOLE_PRODUCT = ("LAPTOP",)
WHOLE_ATTRIBUTES = {"OPERATION_PERFORMANCE": "performance", "QUALITY": "build_quality", "PORTABILITY": "design", "CONNECTIVITY": "performance", "GENERAL": "overall", "DESIGN_FEATURES": "overall", "USABILITY": "overall", "MISCELLANEOUS": "overall"}
PHONE = {
    "Overall": "overall", "Buyer Attitude": "overall", "Branding/Marketing": "overall", "Logistics": "delivery", "Product Packaging": "delivery",
    "Product Quality": "build_quality", "Battery/Longevity": "battery", "Seller Service": "customer_service", "After-sales Service": "customer_service",
    "Screen": "display", "System": "software", "Security": "software", "Intelligent Assistant": "software", "Ease of Use": "software",
    "Performance": "performance", "Product Configuration": "performance", "Signal": "performance", "Smart Connect": "performance", "Price": "price",
    "Camera": "camera", "Shooting Functions": "camera", "Appearance Design": "design", "Key Design": "design", "Audio/Sound": "audio",
}
LAPTOP = {
    "LAPTOP": "overall", "SHIPPING": "delivery", "KEYBOARD": "build_quality", "MOUSE": "build_quality", "PORTS": "build_quality", "MOTHERBOARD": "build_quality",
    "HARDWARE": "build_quality", "BATTERY": "battery", "POWER_SUPPLY": "battery", "SUPPORT": "customer_service", "WARRANTY": "customer_service", "COMPANY": "customer_service",
    "DISPLAY": "display", "GRAPHICS": "display", "SOFTWARE": "software", "OS": "software", "CPU": "performance", "MEMORY": "performance", "HARD_DISC": "performance",
    "FANS&COOLING": "performance", "MULTIMEDIA_DEVICES": "audio",
}


def split_category(category: Column) -> tuple[Column, Column]:
    """Entity and attribute at the first ``#``."""
    parts = F.split(category, "#", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def map_category(category: Column, domain: Column) -> tuple[Column, Column]:
    """(aspect, state) of a raw category; state is dropped, mapped or unknown. The tables are literals: no join."""
    entity, attribute = split_category(category)
    by_entity = F.when(domain == "phone", F.element_at(_map(PHONE), entity)).otherwise(F.element_at(_map(LAPTOP), entity))
    aspect = F.coalesce(F.element_at(_map(OVERRIDES), attribute), F.when(entity.isin(*WHOLE_PRODUCT), F.element_at(_map(WHOLE_ATTRIBUTES), attribute)).otherwise(by_entity))
    dropped = entity.isin(*DROP)
    return F.when(~dropped, aspect), F.when(dropped, "dropped").when(aspect.isNull(), "unknown").otherwise("mapped")


def require_mapped(mapped: DataFrame) -> DataFrame:
    """The rows again; a task fails on the first unknown category."""
    known = F.when(F.col("state") == "unknown", F.raise_error(F.concat(F.lit("unmapped category "), "category")).cast("string")).otherwise(F.col("aspect"))
    return mapped.withColumn("aspect", known)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(value, text, triplets, reject) of ``text####[[term, category, polarity], ...]`` lines."""
    parts = F.split("value", "####", 2)
    text, payload = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    parsed = F.from_json(payload, "array<array<string>>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"})
    reject = (
        F.when(F.size(parts) < 2, "no separator").when(text == "", "empty text").when(~payload.rlike(r"(?s)^\[.*\]$"), "not a list")
        .when(F.col("parsed").isNull() | F.exists("parsed", lambda x: x.isNull()), "unreadable").when(~F.forall("parsed", lambda x: F.size(x) == 3), "wrong shape")
    )
    rows = lines.withColumns({"text": text, "payload": payload, "parsed": parsed}).withColumn("reject", reject)
    triplets = F.transform("parsed", lambda x: F.struct(F.get(x, F.lit(0)).alias("term"), F.get(x, F.lit(1)).alias("category"), F.get(x, F.lit(2)).alias("polarity")))
    return rows.select("value", "text", F.when(F.col("reject").isNull(), triplets).alias("triplets"), "reject")


def majority_vote(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent polarity of each key; ties go by a fixed order among the tied. ``all_tied``: several labels, all equally often."""
    place = F.lit(len(VOTE_ORDER))
    for i, name in enumerate(VOTE_ORDER):
        place = F.when(F.col("polarity") == name, i).otherwise(place)
    counts = pairs.groupBy(*keys, "polarity").agg(F.count("*").alias("n"))
    out = counts.groupBy(*keys).agg(F.min_by("polarity", F.struct(-F.col("n"), place)).alias("polarity"), F.count("*").alias("labels"), (F.min("n") == F.max("n")).alias("_even"), F.sum("n").alias("votes"))
    return out.withColumn("all_tied", (F.col("labels") > 1) & F.col("_even")).drop("_even")


def collect_terms(pairs: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Values of each key in order."""
    return pairs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("terms"))


def split_order(split: Column) -> Column:
    out = F.lit(len(SPLIT_PRIORITY))
    for i, name in enumerate(SPLIT_PRIORITY):
        out = F.when(split == name, i).otherwise(out)
    return out


def dedupe_across_splits(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """One row of each key, from the first split in order of priority; its id is the least of the key."""
    w = Window.partitionBy(key)
    placed = rows.withColumns({"_o": split_order(F.col("split")), "canonical_id": F.min(id_).over(w)})
    return placed.withColumn("_rn", F.row_number().over(w.orderBy("_o", id_))).where("_rn = 1").drop("_o", "_rn")


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in several splits."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


def assert_no_leakage(rows: DataFrame, key: str) -> None:
    found = leakage(rows, key).limit(5).collect()  # examples for the message
    if found:
        raise ValueError(f"keys in several splits: {[r[key] for r in found]}")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def aspect_sets(pairs: DataFrame) -> DataFrame:
    """(review_id, aspects): each review's sorted aspect set, from all its rows."""
    return pairs.groupBy("review_id").agg(F.array_sort(F.collect_set("aspect")).alias("aspects"))


def disjoint_sets(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, pairs): aspect sets without a common aspect, each two once, and how many reviews have them.

    A pair of reviews is disjoint exactly if its sets are: joined with the
    members, the rows give every pair, and none is formed here.
    """
    sizes = sets.groupBy("aspects").agg(F.count("*").alias("n"))
    a, b = (sizes.select(F.col("aspects").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    # of the sets of k aspects there are fewer than 2**k, whatever the number of reviews
    return a.join(F.broadcast(b), (F.col("a") < F.col("b")) & ~F.arrays_overlap("a", "b")).withColumn("pairs", F.col("n_a") * F.col("n_b"))


def compose_benchmark(pairs: DataFrame, size: int, seed: int, strip: bool = False) -> DataFrame:
    """Pseudo-reviews of ``size`` texts with different aspects, from (review_id, text, aspect, polarity).

    Rows of each aspect are numbered in a hash's order; those of one number come
    together, the aspects by hash. No pairs are formed.
    """
    order = F.md5(F.concat(F.col("review_id"), F.lit(f"|{seed}")).cast("binary"))
    single = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("review_id"))).where("_n = 1")
    numbered = single.withColumn("row", F.row_number().over(Window.partitionBy("aspect").orderBy(order, "review_id")))
    mixed = numbered.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(F.md5(F.concat_ws("|", "aspect", F.col("row").cast("string"), F.lit(str(seed))).cast("binary")), "aspect")))
    groups = mixed.withColumn("part", F.floor((F.col("place") - 1) / size))
    text = F.rtrim("text")
    ended = F.regexp_replace(text, "[.!? ]+$", "") if strip else F.when(F.substring(text, -1, 1).isin(".", "!", "?"), text).otherwise(F.concat(text, F.lit(".")))
    made = groups.withColumn("said", ended).groupBy("row", "part").agg(F.array_sort(F.collect_list(F.struct("place", "said", "aspect", "polarity", "review_id"))).alias("x"))
    gold = F.map_from_entries(F.transform("x", lambda r: F.struct(r["aspect"], r["polarity"])))
    return made.where(F.size("x") == size).select(F.concat_ws("-", "row", "part").alias("id"), F.array_join(F.transform("x", lambda r: r["said"]), " ").alias("text"), gold.alias("gold"), F.transform("x", lambda r: r["review_id"]).alias("source_ids"))
