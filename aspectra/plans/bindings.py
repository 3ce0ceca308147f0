"""The driver's tables in the roles of the analytics: facts, listings, reviews, products, pairs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.constants import AXES
from aspectra.operators.profiles import profiles_long, profiles_wide, with_listed_price

EVENT_AXES = (("signup", "battery", 0), ("view", "camera", 1), ("purchase", "price", 2), ("click", "display", 3), ("error", "performance", 4))
FLOOR = 10
REQUIREMENT = {"battery": 6.0, "camera": 5.0, "price": 4.0, "display": 5.0, "performance": 6.0}


class Tables:
    """Role views over one folder of tables; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table's rows dealt over all cores, where its files give fewer splits than there are cores."""
        rows, cores = self.raw(name), self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)

    @cached_property
    def facts(self) -> DataFrame:
        """Scored aspects of reviews, from events."""
        e = self.raw("events")
        aspect, place = F.lit(None).cast("string"), F.lit(0)
        for kind, axis, order in EVENT_AXES:
            aspect = F.when(F.col("event_type") == kind, axis).otherwise(aspect)
            place = F.when(F.col("event_type") == kind, order).otherwise(place)
        factor = 0.5 + ((3 * F.col("user_id") + 5 * place) % 7) / 6.0
        score = 1 + 9 * F.least(F.col("value") * factor, F.lit(100.0)) / 100
        out = e.select(
            F.col("user_id").cast("string").alias("model_key"), F.col("event_id").alias("review_id"), aspect.alias("aspect"), score.alias("score"),
            (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), (1 + F.col("event_id") % 5).alias("rating"), "value", "ts",
        )
        polarity = F.when(F.col("score") < 4.75, "negative").when(F.col("score") <= 6.25, "neutral").otherwise("positive")
        return out.withColumn("polarity", polarity)

    @cached_property
    def flat_facts(self) -> DataFrame:
        """The same without a product effect: the null world."""
        return self.facts.withColumn("score", 1 + 9 * F.least(F.col("value"), F.lit(100.0)) / 100)

    @cached_property
    def products(self) -> DataFrame:
        """Catalogue rows, from parts, with their number of facts."""
        counts = self.facts.groupBy("model_key").agg(F.count("*").alias("reviews_total"), F.avg("rating").alias("avg_rating"))
        p = self.raw("part").select(F.col("p_partkey").cast("string").alias("model_key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 10 == 0).cast("int").alias("simulated"))
        return p.join(counts, "model_key", "left").withColumn("reviews_total", F.coalesce("reviews_total", F.lit(0).cast("long")))

    @cached_property
    def named_products(self) -> DataFrame:
        """Keys and names of the same rows, without their facts, for work that costs far more than a shuffle: dealt over all cores, however few row groups hold them."""
        p = self.raw("part").select(F.col("p_partkey").cast("string").alias("model_key"), F.col("p_name").alias("name"))
        return p.repartition(4 * max(self.spark.sparkContext.defaultParallelism, p.rdd.getNumPartitions()))

    @cached_property
    def listings(self) -> DataFrame:
        p = self.raw("part")
        return p.select(F.col("p_partkey").alias("asin"), F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_brand", "p_name", F.lower("p_type"), F.col("p_size").cast("string")).alias("title"), F.col("p_retailprice").alias("price"), F.concat_ws(" ", "p_brand", "p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("img/"), F.col("p_partkey").cast("string"))).alias("image"))

    @cached_property
    def keyed_listings(self) -> DataFrame:
        return self.listings.withColumn("model_key", F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))))

    @cached_property
    def reviews(self) -> DataFrame:
        """Product reviews, from line items; the id is made of what tells rows apart."""
        i = self.raw("lineitem")
        return i.select(
            F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("string")).alias("review_id"),
            F.col("l_partkey").alias("asin"), F.col("l_suppkey").cast("string").alias("name"), (1 + F.col("l_linenumber") % 5).cast("long").alias("rating"),
            F.concat_ws(" ", "l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 10, F.concat(F.lit("qty "), F.col("l_quantity").cast("int").cast("string")))).alias("body"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """(review, aspect) pairs, from each user's days."""
        f = self.facts
        day = F.date_format("ts", "yyyy-MM-dd")
        polarity = F.when(F.col("value") < 15, "negative").when(F.col("value") < 20, "neutral").otherwise("positive")
        return f.select(F.concat_ws("-", "model_key", day).alias("review_id"), "aspect", polarity.alias("polarity"), F.col("review_id").alias("position"), "model_key", "value", "confidence")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents with a split by hash of the id."""
        from aspectra.functions.scores import hash_uniform

        u = hash_uniform(F.col("doc_id"), "split")
        return self.spread("documents").select("doc_id", "text", "lang", F.when(u < 0.1, "test").when(u < 0.25, "dev").otherwise("train").alias("split"))

    @cached_property
    def predictions(self) -> DataFrame:
        """Truth and two models' answers: the polarity of an event, and what disturbed copies of it say."""
        from aspectra.functions.scores import hash_uniform

        f = self.facts.select("review_id", "model_key", "aspect", F.when(F.col("value") < 15, 0).when(F.col("value") < 20, 1).otherwise(2).alias("y"), "confidence")
        wrong = lambda seed, share: F.when(hash_uniform(F.col("review_id"), seed) < share, (F.col("y") + 1) % 3).otherwise(F.col("y"))
        return f.withColumns({"pred_a": wrong("a", 0.35), "pred_b": wrong("b", 0.25)})

    @cached_property
    def probs(self) -> DataFrame:
        """Probabilities from the first three entries of embeddings."""
        from aspectra.functions.scores import softmax

        e = self.raw("embeddings").select(F.col("vec_id"), (F.col("label") % 3).alias("y"), *(F.col("embedding")[i].cast("double").alias(f"l{i}") for i in range(3)))
        p = softmax([F.col(f"l{i}") * 4 for i in range(3)])
        return e.select("vec_id", "y", "l0", "l1", "l2", *(x.alias(n) for x, n in zip(p, ("p_negative", "p_neutral", "p_positive"))))

    @cached_property
    def long(self) -> DataFrame:
        return profiles_long(self.facts, FLOOR)

    @cached_property
    def priced(self) -> DataFrame:
        return with_listed_price(self.long, self.products)

    @cached_property
    def wide(self) -> DataFrame:
        return profiles_wide(self.priced)


# The same roles for DuckDB. Each names the views that it needs; `sql` puts them in order.
_AXIS = " ".join(f"WHEN '{k}' THEN '{a}'" for k, a, _ in EVENT_AXES)
_ORD = " ".join(f"WHEN '{k}' THEN {o}" for k, _, o in EVENT_AXES)
U = "(('0x'||substr(md5({key}||'|{seed}'),1,8))::BIGINT/4294967296e0)"


def uniform(key: str, seed: str) -> str:
    return U.format(key=f"CAST({key} AS VARCHAR)", seed=seed)


_L = "4*CAST(embedding[{i}] AS DOUBLE)"
VIEWS = {
    "facts": ((), f"SELECT *, CASE WHEN score<4.75e0 THEN 'negative' WHEN score<=6.25e0 THEN 'neutral' ELSE 'positive' END AS polarity FROM (SELECT CAST(user_id AS VARCHAR) AS model_key, event_id AS review_id, CASE event_type {_AXIS} END AS aspect, 1+9*least(value*(0.5e0+((3*user_id+5*(CASE event_type {_ORD} END))%7)/6e0),100e0)/100e0 AS score, CAST(regexp_extract(props,'\"k\": *([0-9]+)',1) AS DOUBLE)/100e0 AS confidence, 1+event_id%5 AS rating, value, ts FROM events)"),
    "flat": (("facts",), "SELECT * REPLACE (1+9*least(value,100e0)/100e0 AS score) FROM facts"),
    "products": (("facts",), "SELECT CAST(p_partkey AS VARCHAR) AS model_key, p_name AS name, p_brand AS brand, p_retailprice AS price, CAST(p_partkey%10=0 AS INTEGER) AS simulated, coalesce(n,0) AS reviews_total, avg_rating FROM part LEFT JOIN (SELECT model_key, count(*) AS n, avg(rating) AS avg_rating FROM facts GROUP BY 1) c ON c.model_key=CAST(p_partkey AS VARCHAR)"),
    "listings": ((), "SELECT p_partkey AS asin, p_brand AS brand, p_brand||' '||p_name||' '||lower(p_type)||' '||CAST(p_size AS VARCHAR) AS title, p_retailprice AS price, p_brand||' '||p_name AS name, CASE WHEN p_partkey%3<>0 THEN 'img/'||CAST(p_partkey AS VARCHAR) END AS image, lower(trim(p_brand||' '||p_name)) AS model_key FROM part"),
    "reviews": ((), "SELECT CAST(l_orderkey AS VARCHAR)||'-'||CAST(l_linenumber AS VARCHAR)||'-'||CAST(l_partkey AS VARCHAR)||'-'||CAST(l_suppkey AS VARCHAR)||'-'||CAST(CAST(floor(l_extendedprice*100+0.5e0) AS BIGINT) AS VARCHAR) AS review_id, l_partkey AS asin, CAST(l_suppkey AS VARCHAR) AS name, CAST(1+l_linenumber%5 AS BIGINT) AS rating, l_returnflag||' '||l_linestatus||CASE WHEN l_quantity>10 THEN ' qty '||CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE '' END AS body FROM lineitem"),
    "pairs": (("facts",), "SELECT model_key||'-'||strftime(ts,'%Y-%m-%d') AS review_id, aspect, CASE WHEN value<15 THEN 'negative' WHEN value<20 THEN 'neutral' ELSE 'positive' END AS polarity, review_id AS position, model_key, value, confidence FROM facts"),
    "texts": ((), f"SELECT doc_id, text, lang, CASE WHEN {uniform('doc_id', 'split')}<0.1e0 THEN 'test' WHEN {uniform('doc_id', 'split')}<0.25e0 THEN 'dev' ELSE 'train' END AS split FROM documents"),
    "preds": (("facts",), f"SELECT *, CASE WHEN {uniform('review_id', 'a')}<0.35e0 THEN (y+1)%3 ELSE y END AS pred_a, CASE WHEN {uniform('review_id', 'b')}<0.25e0 THEN (y+1)%3 ELSE y END AS pred_b FROM (SELECT review_id, model_key, aspect, CASE WHEN value<15 THEN 0 WHEN value<20 THEN 1 ELSE 2 END AS y, confidence FROM facts)"),
    "probs": ((), "SELECT vec_id, y, l0, l1, l2, e0/(e0+e1+e2) AS p_negative, e1/(e0+e1+e2) AS p_neutral, e2/(e0+e1+e2) AS p_positive FROM (SELECT *, exp(4*l0-greatest(4*l0,4*l1,4*l2)) AS e0, exp(4*l1-greatest(4*l0,4*l1,4*l2)) AS e1, exp(4*l2-greatest(4*l0,4*l1,4*l2)) AS e2 FROM (SELECT vec_id, label%3 AS y, CAST(embedding[1] AS DOUBLE) AS l0, CAST(embedding[2] AS DOUBLE) AS l1, CAST(embedding[3] AS DOUBLE) AS l2 FROM embeddings))"),
    "cells": (("facts",), "SELECT model_key, aspect, count(*) AS n, avg(score) AS mean, var_samp(score) AS var, avg(confidence) AS mean_confidence FROM facts GROUP BY 1,2"),
    "params": (("cells",), "SELECT *, CASE WHEN between_var>0 THEN within_var/between_var END AS k FROM (SELECT *, greatest(coalesce(observed_var-within_var/mean_n,0e0),0e0) AS between_var FROM (SELECT aspect, sum(n*mean)/sum(n) AS grand_mean, avg(var) AS within_var, var_samp(mean) AS observed_var, avg(n) AS mean_n, count(*) AS products FROM cells GROUP BY 1))"),
    "long": (("cells", "params"), f"SELECT model_key, c.aspect AS aspect, coalesce((n*mean+k*grand_mean)/(n+k),grand_mean) AS score, mean AS raw_score, n AS mentions, mean_confidence FROM cells c JOIN params p ON p.aspect=c.aspect WHERE n>={FLOOR}"),
    "bounds": (("products",), "SELECT CASE WHEN p5<p95 THEN p5 ELSE lo END AS cheapest, CASE WHEN p5<p95 THEN p95 ELSE hi END AS dearest, n FROM (SELECT quantile_cont(price,0.05) AS p5, quantile_cont(price,0.95) AS p95, min(price) AS lo, max(price) AS hi, count(*) AS n FROM products WHERE price>0 AND simulated=0)"),
    "listed": (("products", "bounds"), "SELECT model_key, 'price' AS aspect, coalesce(10-9*(ln(least(greatest(price,cheapest),dearest))-ln(cheapest))/nullif(ln(dearest)-ln(cheapest),0),5.5e0) AS score, reviews_total AS mentions FROM products, bounds WHERE price>0"),
    "priced": (("long", "listed"), "SELECT model_key, aspect, score, raw_score, mentions, mean_confidence FROM long WHERE aspect<>'price' UNION ALL SELECT model_key, aspect, score, score, mentions, NULL FROM listed"),
    "wide": (("priced",), "SELECT * FROM (SELECT model_key, " + ", ".join(f"max(CASE WHEN aspect='{a}' THEN score END) AS {a}" for a in AXES) + " FROM priced GROUP BY 1) WHERE " + " AND ".join(f"{a} IS NOT NULL" for a in AXES)),
}


def sql(views: str, select: str) -> str:
    """A SELECT with the role views that it names, and those that they need, as common tables."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for view in views.split():
        need(view)
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    if not head:
        return select
    return f"WITH {head}, {select[5:]}" if select.upper().startswith("WITH ") else f"WITH {head} {select}"
