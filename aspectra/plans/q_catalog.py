"""Queries on scans, listings, reviews and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.scores import r6
from aspectra.operators import catalog as C
from aspectra.operators import recommend as M
from aspectra.plans.bindings import Tables, sql
from aspectra.operators.quantiles import grouped_quantiles
from aspectra.operators.search import TrigramIndex
from aspectra.plans.registry import query


@query(sql("listings", "SELECT asin, brand, title, price FROM listings"))
def scan_listings(t: Tables) -> DataFrame:
    return t.listings.select("asin", "brand", "title", "price")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS model_key FROM events")
def scan_pruned_keys(t: Tables) -> DataFrame:
    """One column of the file is read."""
    return t.raw("events").select(F.col("user_id").cast("string").alias("model_key")).distinct()


@query("SELECT kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY 1")
def scan_union_splits(t: Tables) -> DataFrame:
    parts = [t.raw(n).select(F.lit(n).alias("kind"), "text") for n in ("documents", "conversations", "benchmark")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def scan_limit(t: Tables) -> DataFrame:
    return t.raw("documents").orderBy("doc_id").limit(25).select("doc_id", "lang")


@query("""SELECT event_id, CAST(regexp_extract(props,'"k": *([0-9]+)',1) AS BIGINT) AS k FROM events""")
def scan_json_props(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query(sql("facts", "SELECT DISTINCT model_key FROM facts WHERE model_key NOT IN (SELECT model_key FROM facts WHERE aspect='battery' AND score>6)"))
def resume_pending_keys(t: Tables) -> DataFrame:
    """Keys that no finished row names."""
    done = t.facts.where("aspect = 'battery' AND score > 6").select("model_key").distinct()
    return t.facts.select("model_key").distinct().join(done, "model_key", "left_anti")


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn<=3")
def latest_reviews_for_key(t: Tables) -> DataFrame:
    return C.latest(t.raw("events"), "user_id", "event_id", 3).select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


@query(sql("listings", "SELECT asin, name, model_key, CAST(len(string_split(trim(name),' '))>=2 AND model_key<>lower(trim(brand)) AS BOOLEAN) AS usable FROM listings"))
def listing_model_keys(t: Tables) -> DataFrame:
    return C.attach_models(t.keyed_listings).select("asin", "name", "model_key", "usable")


@query(sql("listings", "SELECT count(*) AS kept, (SELECT count(*) FROM listings)-count(*) AS rejected, min(asin) AS first_asin FROM listings WHERE len(string_split(trim(name),' '))>=3"))
def filter_usable(t: Tables) -> DataFrame:
    usable = F.size(F.split(F.trim("name"), " ")) >= 3
    return t.listings.agg(F.count_if(usable).alias("kept"), F.count_if(~usable).alias("rejected"), F.min(F.when(usable, F.col("asin"))).alias("first_asin"))


@query(sql("reviews", "SELECT review_id, len(list_filter(string_split_regex(body,'\\s+'), lambda x: x<>'')) AS words FROM reviews WHERE len(list_filter(string_split_regex(body,'\\s+'), lambda x: x<>''))>=3"))
def filter_min_words(t: Tables) -> DataFrame:
    words = C.word_count(F.col("body"))
    return t.reviews.select("review_id", words.cast("long").alias("words")).where("words >= 3")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1','Brand#2','Brand#7')")
def filter_membership(t: Tables) -> DataFrame:
    return t.raw("part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#7")).select("p_partkey", "p_brand")


@query(sql("products", "SELECT model_key, name, brand, reviews_total, total FROM (SELECT *, count(*) OVER () AS total FROM products WHERE simulated=0 AND lower(brand)='brand#7' AND contains(lower(name),'re')) ORDER BY reviews_total DESC, model_key LIMIT 10 OFFSET 2"))
def catalog_search(t: Tables) -> DataFrame:
    return M.search(t.products, " RE ", "BRAND#7", False, 10, 2).select("model_key", "name", "brand", "reviews_total", "total")


@query(sql("products", "SELECT model_key, name, brand, reviews_total, total FROM (SELECT *, count(*) OVER () AS total FROM products WHERE simulated=0 AND lower(brand)='brand#7' AND contains(lower(name),'re')) ORDER BY reviews_total DESC, model_key LIMIT 10 OFFSET 2"))
def catalog_search_indexed(t: Tables) -> DataFrame:
    """The same page by the index of trigrams."""
    index = TrigramIndex.of(t.products, "model_key", "name")
    fits = (F.col("simulated") == 0) & (F.lower("brand") == "brand#7")
    return index.search(" RE ", [F.desc("reviews_total"), F.col("model_key")], 10, 2, fits).select("model_key", "name", "brand", "reviews_total", "total")


@query(sql("products", "SELECT model_key, name FROM products WHERE coalesce(simulated,0)=0 AND NOT starts_with(model_key,'1')"))
def strip_merged_rows(t: Tables) -> DataFrame:
    """Rows of an earlier merge go by flag and by key prefix."""
    return C.strip_merged(t.products, "1").select("model_key", "name")


@query(sql("products", "SELECT DISTINCT brand FROM products WHERE trim(brand)<>''"))
def distinct_brands(t: Tables) -> DataFrame:
    return t.products.select("brand").where(F.trim("brand") != "").distinct()


_JOINED = "SELECT r.*, l.model_key FROM reviews r JOIN listings l ON l.asin=r.asin"


@query(sql("reviews listings", f"SELECT model_key, count(*) AS n, CAST(sum(rating) AS BIGINT) AS stars FROM ({_JOINED}) GROUP BY 1"))
def reviews_with_models(t: Tables) -> DataFrame:
    return C.with_models(t.reviews, t.keyed_listings).groupBy("model_key").agg(F.count("*").alias("n"), F.sum("rating").alias("stars"))


@query(sql("reviews listings", f"SELECT model_key FROM ({_JOINED}) GROUP BY 1 HAVING count(*)>=40 INTERSECT SELECT model_key FROM listings WHERE price>950"))
def keep_priced_semi(t: Tables) -> DataFrame:
    counts = C.with_models(t.reviews, t.keyed_listings).groupBy("model_key").count().where("count >= 40")
    return counts.select("model_key").join(t.keyed_listings.where("price > 950"), "model_key", "left_semi")


@query(sql("listings", "SELECT model_key, round(median(price),6) AS price FROM listings WHERE price>0 GROUP BY 1"))
def median_price_by_model(t: Tables) -> DataFrame:
    return grouped_quantiles(t.keyed_listings.where("price > 0"), "model_key", "price", [0.5], ["price"]).select("model_key", r6("price").alias("price"))


@query(sql("reviews listings", f"SELECT model_key, round(avg(rating),6) AS avg_rating FROM ({_JOINED}) GROUP BY 1"))
def avg_rating_by_model(t: Tables) -> DataFrame:
    return C.with_models(t.reviews, t.keyed_listings).groupBy("model_key").agg(r6(F.avg("rating")).alias("avg_rating"))


_COUNTS = "SELECT l.asin AS asin, l.model_key AS model_key, name, image, coalesce(n,0) AS n FROM listings l LEFT JOIN (SELECT asin, count(*) AS n FROM reviews GROUP BY 1) c ON c.asin=l.asin"


def _primary_sql(column: str) -> str:
    return f"(SELECT model_key, {column} AS v FROM (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY n DESC, asin) AS rn FROM c WHERE {column} IS NOT NULL) WHERE rn=1)"


@query(sql("listings reviews", f"WITH c AS ({_COUNTS}) SELECT k.model_key AS model_key, a.v AS asin, b.v AS image FROM (SELECT DISTINCT model_key FROM c) k LEFT JOIN {_primary_sql('asin')} a ON a.model_key=k.model_key LEFT JOIN {_primary_sql('image')} b ON b.model_key=k.model_key"))
def primary_listing(t: Tables) -> DataFrame:
    """The first non-null value of each column by review count."""
    return C.primary_listing(t.keyed_listings, t.reviews).select("model_key", "asin", "image")


_DEDUPED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_key, name, body ORDER BY review_id) AS rn FROM (" + _JOINED + ")) WHERE rn=1"


@query(sql("reviews listings", f"SELECT model_key, name, body, review_id FROM ({_DEDUPED})"))
def dedupe_reviews(t: Tables) -> DataFrame:
    return C.keep_first(C.with_models(t.reviews, t.keyed_listings), ["model_key", "name", "body"], ["review_id"]).select("model_key", "name", "body", "review_id")


_CAND = f"WITH j AS (SELECT * FROM ({_JOINED.replace('r.*', 'r.review_id, r.rating, r.name, r.body')}) WHERE len(string_split(body,' '))>=3), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_key, name, body ORDER BY review_id) AS rn FROM j) WHERE rn=1), c AS (SELECT model_key, count(*) AS reviews_total, avg(rating) AS avg_rating FROM d GROUP BY 1 HAVING count(*)>=20), p AS (SELECT model_key, median(price) AS price, count(*) AS listings FROM listings WHERE price>0 GROUP BY 1)"


@query(sql("reviews listings", f"{_CAND} SELECT c.model_key AS model_key, reviews_total, round(avg_rating,6) AS avg_rating, round(price,6) AS price, listings, least(reviews_total,40) AS reviews_sampled FROM c JOIN p ON p.model_key=c.model_key"))
def catalog_candidates(t: Tables) -> DataFrame:
    """The whole candidate build in one plan."""
    products, _ = C.build_candidates(t.keyed_listings, t.reviews, min_reviews=20, cap=40)
    return products.select("model_key", "reviews_total", r6("avg_rating").alias("avg_rating"), r6("price").alias("price"), "listings", "reviews_sampled")


@query(sql("reviews listings", f"{_CAND} SELECT count(*) AS reviews_in, CAST(sum(CASE WHEN len(string_split(body,' '))<3 THEN 1 ELSE 0 END) AS BIGINT) AS too_short, (SELECT count(*) FROM j)-(SELECT count(*) FROM d) AS duplicates, (SELECT count(DISTINCT model_key) FROM d)-(SELECT count(*) FROM c) AS below_floor, (SELECT count(*) FROM c JOIN p ON p.model_key=c.model_key) AS products FROM reviews"))
def catalog_report(t: Tables) -> DataFrame:
    return C.report(t.keyed_listings, t.reviews, min_reviews=20)


@query(sql("reviews listings", f"SELECT model_key, review_id FROM (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY md5(review_id||'|0'), review_id) AS s FROM ({_DEDUPED})) WHERE s<=15"))
def sample_cap_per_group(t: Tables) -> DataFrame:
    deduped = C.keep_first(C.with_models(t.reviews, t.keyed_listings), ["model_key", "name", "body"], ["review_id"])
    return C.sample_cap(deduped, "model_key", "review_id", 15, 0).select("model_key", "review_id")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)||'|7'), doc_id LIMIT 50")
def sample_n(t: Tables) -> DataFrame:
    """A seeded sample of a number of rows: a sampling operator."""
    return C.sample_n(t.raw("documents").select("doc_id"), "doc_id", 50, 7)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_number, lang||'-'||source||'-'||CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) AS review_id FROM documents")
def enumerate_rows(t: Tables) -> DataFrame:
    out = C.enumerate_rows(t.raw("documents").select("doc_id", "lang", "source"), "doc_id", "line_number")
    return out.select("doc_id", "line_number", F.concat_ws("-", "lang", "source", F.col("line_number").cast("string")).alias("review_id"))


@query(sql("products", "SELECT model_key, name, simulated, reviews_total, avg_rating IS NULL AS no_rating FROM products WHERE simulated=0 UNION ALL SELECT 'sim:'||model_key, name, 1, NULL, true FROM products WHERE simulated=1"))
def union_simulated(t: Tables) -> DataFrame:
    """Union by name; columns that one side lacks are null."""
    real = t.products.where("simulated = 0").select("model_key", "name", "simulated", "reviews_total", "avg_rating")
    made = t.products.where("simulated = 1").select(F.concat(F.lit("sim:"), "model_key").alias("model_key"), "name", F.lit(1).alias("simulated"))
    return real.unionByName(made, allowMissingColumns=True).select("model_key", "name", "simulated", "reviews_total", F.col("avg_rating").isNull().alias("no_rating"))


@query(sql("pairs", "SELECT aspect, polarity, count(*) AS n FROM pairs GROUP BY 1,2"))
def aspect_polarity_counts(t: Tables) -> DataFrame:
    return t.pairs.groupBy("aspect", "polarity").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM part) AS products, count(*) AS orphans FROM events WHERE user_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey%3<>0)")
def orphan_reviews(t: Tables) -> DataFrame:
    """Facts whose product is unknown: an anti join, which repeated keys don't distort."""
    known = t.raw("part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("user_id"))
    orphans = t.raw("events").join(known, "user_id", "left_anti").agg(F.count("*").alias("orphans"))
    return t.raw("part").agg(F.count("*").alias("products")).crossJoin(F.broadcast(orphans))
