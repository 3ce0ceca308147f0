"""Queries on profiles, ranking, reliability and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.constants import AXES, SPLIT_REPEATS
from aspectra.functions import scores as S
from aspectra.functions.scores import NULL_RATIO, RECOVERY, RELIABILITY, hash_uniform, ladder, r6
from aspectra.operators import profiles as P
from aspectra.operators import reliability as R
from aspectra.operators import recommend as M
from aspectra.plans.bindings import FLOOR, REQUIREMENT, Tables, sql, uniform
from aspectra.operators.quantiles import grouped_quantiles
from aspectra.plans.registry import query
from aspectra.sources.shared import written

_NEED = {a: f"{v:g}e0" for a, v in REQUIREMENT.items()}


def _gap_sql(need: dict[str, str]) -> str:
    gaps = ", ".join(f"greatest(0e0,{n}-{a}) AS gap_{a}" for a, n in need.items())
    sq = "+".join(f"gap_{a}*gap_{a}" for a in AXES)
    asked = "+".join(f"({n}-1)*({n}-1)" for n in (need[a] for a in AXES))
    top = "greatest(" + ",".join(f"gap_{a}" for a in AXES) + ")"
    worst = "CASE WHEN " + top + "<=0 THEN NULL " + " ".join(f"WHEN gap_{a}={top} THEN '{a}'" for a in AXES) + " END"
    mean = "(" + "+".join(AXES) + ")/5e0"
    return gaps, f"100e0*(1-coalesce(sqrt({sq})/nullif(sqrt({asked}),0),0)) AS match_percent", f"{mean} AS mean_profile", f"{worst} AS worst_axis"


_G, _MATCH, _MEAN, _WORST = _gap_sql(_NEED)
_RANKED = f"SELECT *, {_MATCH}, {_MEAN}, {_WORST} FROM (SELECT *, {_G} FROM wide)"
_ORDER = "round(match_percent,6) DESC, round(mean_profile,6) DESC, model_key"
_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ({_RANKED})) WHERE rank<=10"
_GAPS6 = ", ".join(f"round(gap_{a},6) AS gap_{a}" for a in AXES)


@query(sql("wide", f"SELECT model_key, rank, round(match_percent,6) AS match_percent, {_GAPS6}, worst_axis FROM ({_TOP})"))
def recommend_topk(t: Tables) -> DataFrame:
    out = M.rank(t.wide, REQUIREMENT, 10, 6)
    return out.select("model_key", "rank", r6("match_percent").alias("match_percent"), *(r6(f"gap_{a}").alias(f"gap_{a}") for a in AXES), "worst_axis")


@query(sql("wide products bounds", f"SELECT r.model_key AS model_key, rank, name, brand, p.price AS price, round(match_percent,6) AS match_percent, round(exp(ln(cheapest)+(10-4e0)/9*(ln(dearest)-ln(cheapest))),6) AS price_target FROM ({_TOP}) r JOIN products p ON p.model_key=r.model_key, bounds"))
def recommend_enriched(t: Tables) -> DataFrame:
    """Ranked keys joined back to products, with the price that the slider stands for."""
    top = M.rank(t.wide, REQUIREMENT, 10, 6)  # ten rows
    bounds = P.price_bounds(t.products)
    target = S.score_to_price(F.lit(REQUIREMENT["price"]), F.col("cheapest"), F.col("dearest"))
    return t.products.join(F.broadcast(top.select("model_key", "rank", "match_percent")), "model_key").crossJoin(F.broadcast(bounds)).select("model_key", "rank", "name", "brand", "price", r6("match_percent").alias("match_percent"), r6(target).alias("price_target"))


_QUERIES = [(i, {a: float(1 + (7 * i + 3 * j) % 9) for j, a in enumerate(AXES)}) for i in range(1, 6)]
_REQ_SQL = " UNION ALL ".join(f"SELECT {i} AS query_id, " + ", ".join(f"{v:g}e0 AS need_{a}" for a, v in need.items()) for i, need in _QUERIES)
_G2, _MATCH2, _MEAN2, _WORST2 = _gap_sql({a: f"need_{a}" for a in AXES})


@query(sql("wide", f"SELECT CAST(query_id AS INTEGER) AS query_id, model_key, rank, round(match_percent,6) AS match_percent, worst_axis FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM (SELECT *, {_MATCH2}, {_MEAN2}, {_WORST2} FROM (SELECT *, {_G2} FROM wide, ({_REQ_SQL})))) WHERE rank<=5"))
def recommend_multi(t: Tables) -> DataFrame:
    """A given set of five requirements against all profiles."""
    asked = t.spark.createDataFrame([(i, *need.values()) for i, need in _QUERIES], "query_id int, " + ", ".join(f"need_{a} double" for a in AXES))
    return M.rank_many(t.wide, asked, 5).select("query_id", "model_key", "rank", r6("match_percent").alias("match_percent"), "worst_axis")


@query(sql("wide", f"SELECT CAST(query_id AS INTEGER) AS query_id, model_key, rank, round(match_percent,6) AS match_percent, worst_axis FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM (SELECT *, {_MATCH2}, {_MEAN2}, {_WORST2} FROM (SELECT *, {_G2} FROM wide, ({_REQ_SQL})))) WHERE rank<=5"))
def recommend_multi_indexed(t: Tables) -> DataFrame:
    """The same from cells of profiles whose bounds reach a requirement's best ones."""
    asked = t.spark.createDataFrame([(i, *need.values()) for i, need in _QUERIES], "query_id int, " + ", ".join(f"need_{a} double" for a in AXES))
    ranked, _ = M.ProfileIndex.of(t.wide).rank_many(asked, 5)
    return ranked.select("query_id", "model_key", "rank", r6("match_percent").alias("match_percent"), "worst_axis")


@query(sql("long", "SELECT model_key, aspect, round(score,6) AS score, round(raw_score,6) AS raw_score, mentions, round(mean_confidence,6) AS mean_confidence FROM long"))
def profiles_long(t: Tables) -> DataFrame:
    return t.long.select("model_key", "aspect", r6("score").alias("score"), r6("raw_score").alias("raw_score"), "mentions", r6("mean_confidence").alias("mean_confidence"))


@query(sql("priced", "SELECT model_key, aspect, round(score,6) AS score, CAST(mentions AS BIGINT) AS mentions FROM priced"))
def profiles_with_price(t: Tables) -> DataFrame:
    return t.priced.select("model_key", "aspect", r6("score").alias("score"), "mentions")


@query(sql("wide", "SELECT model_key, " + ", ".join(f"round({a},6) AS {a}" for a in AXES) + " FROM wide"))
def profiles_wide(t: Tables) -> DataFrame:
    return t.wide.select("model_key", *(r6(a).alias(a) for a in AXES))


_PARAMS = "SELECT aspect, round(grand_mean,6) AS grand_mean, round(within_var,6) AS within_var, round(observed_var,6) AS observed_var, round(between_var,6) AS between_var, round(k,6) AS k, products FROM params"


def _params(facts: DataFrame) -> DataFrame:
    p = P.shrinkage_params(P.cell_means(facts))
    return p.select("aspect", *(r6(c).alias(c) for c in ("grand_mean", "within_var", "observed_var", "between_var", "k")), "products")


@query(sql("params", _PARAMS))
def shrinkage_params(t: Tables) -> DataFrame:
    return _params(t.facts)


@query(sql("params", _PARAMS).replace("least(value*(0.5e0+((3*user_id+5*(CASE event_type", "least(value*(1e0+0*((3*user_id+5*(CASE event_type").replace("END))%7)/6e0)", "END))%7))"))
def shrinkage_null_world(t: Tables) -> DataFrame:
    """Scores without a product effect: no variance between products, k infinite (null) on some axes."""
    return _params(t.flat_facts)


@query(sql("bounds", "SELECT round(cheapest,6) AS cheapest, round(dearest,6) AS dearest, n FROM bounds"))
def price_bounds(t: Tables) -> DataFrame:
    return P.price_bounds(t.products).select(r6("cheapest").alias("cheapest"), r6("dearest").alias("dearest"), "n")


@query(sql("listed", "SELECT model_key, round(score,6) AS price_score FROM listed"))
def price_score(t: Tables) -> DataFrame:
    return t.priced.where("aspect = 'price'").select("model_key", r6("score").alias("price_score"))


@query(sql("long bounds", "SELECT model_key, aspect, round(exp(ln(cheapest)+(10-least(greatest(score,1e0),10e0))/9*(ln(dearest)-ln(cheapest))),6) AS price FROM long, bounds"))
def score_to_price(t: Tables) -> DataFrame:
    out = t.long.crossJoin(F.broadcast(P.price_bounds(t.products)))
    return out.select("model_key", "aspect", r6(S.score_to_price(F.col("score"), F.col("cheapest"), F.col("dearest"))).alias("price"))


@query(sql("wide", " UNION ALL ".join(f"SELECT '{a}' AS axis, count({a}) AS products, round(min({a}),6) AS lowest, round(median({a}),6) AS middle, round(max({a}),6) AS highest, round(stddev_samp({a}),6) AS sd, round(max({a})-min({a}),6) AS spread FROM wide" for a in AXES)))
def axis_spread(t: Tables) -> DataFrame:
    tall = written(t.wide.unpivot("model_key", list(AXES), "axis", "v"), "axes")
    middles = grouped_quantiles(tall, "axis", "v", [0.5], ["middle"])
    return tall.groupBy("axis").agg(F.count("v").alias("products"), r6(F.min("v")).alias("lowest"), r6(F.max("v")).alias("highest"), r6(F.stddev_samp("v")).alias("sd"), r6(F.max("v") - F.min("v")).alias("spread")).join(middles.select("axis", r6("middle").alias("middle")), "axis")


_EVIDENCE = "SELECT *, 'mention '||CAST(review_id AS VARCHAR)||' of '||aspect||' || more' AS evidence FROM facts"


@query(sql("facts", f"SELECT model_key, aspect, polarity, round(score,6) AS score, split_part(evidence,' || ',1) AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY model_key,aspect,polarity ORDER BY CASE WHEN polarity='negative' THEN score ELSE -score END, review_id) AS r FROM ({_EVIDENCE}) WHERE polarity<>'neutral' AND length(split_part(evidence,' || ',1))>=20) WHERE r<=1"))
def evidence_selection(t: Tables) -> DataFrame:
    said = t.facts.withColumn("evidence", F.concat(F.lit("mention "), F.col("review_id").cast("string"), F.lit(" of "), "aspect", F.lit(" || more")))
    return P.select_evidence(said).select("model_key", "aspect", "polarity", r6("score").alias("score"), "sentence")


@query(sql("products priced", "SELECT p.model_key AS model_key, name, brand, price, simulated, reviews_total, string_agg(aspect||'='||CASE WHEN aspect='price' THEN 'listed_price' ELSE 'reviews' END||':'||CAST(mentions AS VARCHAR), ';' ORDER BY aspect) AS axes FROM products p LEFT JOIN priced q ON q.model_key=p.model_key GROUP BY ALL").replace("string_agg(", "coalesce(string_agg(").replace("ORDER BY aspect) AS axes", "ORDER BY aspect),'') AS axes"))
def catalog_nested(t: Tables) -> DataFrame:
    """Products with their profile nested, here as text."""
    one = F.concat("aspect", F.lit("="), F.when(F.col("aspect") == "price", "listed_price").otherwise("reviews"), F.lit(":"), F.col("mentions").cast("string"))
    nested = t.priced.groupBy("model_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("aspect", one.alias("s")))), lambda s: s["s"]), ";").alias("axes"))
    return t.products.join(nested, "model_key", "left").select("model_key", "name", "brand", "price", "simulated", "reviews_total", F.coalesce("axes", F.lit("")).alias("axes"))


@query(sql("facts", f"SELECT f.model_key AS model_key, review_id, round(score,6) AS score FROM facts f JOIN (SELECT model_key FROM facts WHERE aspect='battery' GROUP BY 1 HAVING count(*)>={FLOOR}) k ON k.model_key=f.model_key WHERE aspect='battery'"))
def having_floor_semi(t: Tables) -> DataFrame:
    own = t.facts.where("aspect = 'battery'")
    keys = own.groupBy("model_key").count().where(F.col("count") >= FLOOR)
    return own.join(keys, "model_key", "left_semi").select("model_key", "review_id", r6("score").alias("score"))


_STARS = "stars AS (SELECT model_key, avg(rating) AS stars FROM facts GROUP BY 1), c AS (SELECT * FROM cells WHERE n>=10), j AS (SELECT aspect, mean AS x, stars AS y FROM c JOIN stars s ON s.model_key=c.model_key), r AS (SELECT *, rank() OVER (PARTITION BY aspect ORDER BY x)+(count(*) OVER (PARTITION BY aspect,x)-1)/2e0 AS rx, rank() OVER (PARTITION BY aspect ORDER BY y)+(count(*) OVER (PARTITION BY aspect,y)-1)/2e0 AS ry FROM j)"


@query(sql("cells", f"WITH {_STARS} SELECT aspect, count(*) AS products, round(corr(x,y),6) AS pearson, round(corr(rx,ry),6) AS spearman, round(corr(x,y)*corr(x,y),6) AS r_squared FROM r GROUP BY 1"))
def star_baseline(t: Tables) -> DataFrame:
    """How far an aspect's product means restate the star rating."""
    return R.star_baseline(t.facts, FLOOR).select("aspect", "products", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"), r6("r_squared").alias("r_squared"))


@query(sql("facts", "SELECT review_id, aspect, round(rank() OVER (PARTITION BY aspect ORDER BY score)+(count(*) OVER (PARTITION BY aspect,score)-1)/2e0,6) AS average_rank FROM facts"))
def average_rank(t: Tables) -> DataFrame:
    return R.average_rank(t.facts, "aspect", "score", "average_rank").select("review_id", "aspect", r6("average_rank").alias("average_rank"))


_HALVES = f"rep AS (SELECT unnest(range({SPLIT_REPEATS})) AS i), s AS (SELECT model_key, aspect, i, score, row_number() OVER (PARTITION BY model_key,aspect,i ORDER BY md5(CAST(review_id AS VARCHAR)||'|'||CAST(i AS VARCHAR)), review_id) AS rn, count(*) OVER (PARTITION BY model_key,aspect,i) AS n FROM facts, rep), h AS (SELECT model_key, aspect, i, avg(CASE WHEN rn<=n//2 THEN score END) AS a, avg(CASE WHEN rn>n//2 THEN score END) AS b FROM s WHERE n>=10 GROUP BY 1,2,3), r AS (SELECT *, rank() OVER (PARTITION BY aspect,i ORDER BY a)+(count(*) OVER (PARTITION BY aspect,i,a)-1)/2e0 AS ra, rank() OVER (PARTITION BY aspect,i ORDER BY b)+(count(*) OVER (PARTITION BY aspect,i,b)-1)/2e0 AS rb FROM h), c AS (SELECT aspect, i, corr(a,b) AS p, corr(ra,rb) AS s, avg(abs(a-b)) AS g, count(*) AS n FROM r GROUP BY 1,2)"
_SPLIT = f"WITH {_HALVES} SELECT aspect, max(n) AS products, round(avg(s),6) AS spearman, round(2*avg(s)/(1+avg(s)),6) AS spearman_brown, round(avg(p),6) AS pearson, round(avg(g),6) AS mean_abs_gap FROM c GROUP BY 1"
_VERDICT = "CASE WHEN {v}>=0.8 THEN 'strong' WHEN {v}>=0.6 THEN 'usable' WHEN {v}>=0.4 THEN 'weak' ELSE 'NOISE' END"


def _verdicts(t: Tables) -> DataFrame:
    out = R.split_half(t.facts, FLOOR)
    return out.select("aspect", r6("spearman_brown").alias("spearman_brown"), ladder(F.col("spearman_brown"), *RELIABILITY).alias("verdict"))


def _halves(t: Tables) -> DataFrame:
    out = R.split_half(t.facts, FLOOR)
    return out.select("aspect", "products", *(r6(c).alias(c) for c in ("spearman", "spearman_brown", "pearson", "mean_abs_gap")))


def _gate(t: Tables) -> DataFrame:
    both = R.split_half(t.facts, FLOOR).select("aspect", "spearman_brown").join(R.star_baseline(t.facts, FLOOR).select("aspect", "r_squared"), "aspect")
    usable, redundant = F.count_if(F.col("spearman_brown") >= 0.6), F.count_if(F.col("r_squared") >= 0.9)
    out = both.agg(usable.alias("usable_axes"), redundant.alias("redundant_axes"), F.count("*").alias("axes"))
    return out.select(F.when(F.col("usable_axes") == 0, "FAIL").when(F.col("redundant_axes") > 0, "PARTIAL").otherwise("PASS").alias("verdict"), "usable_axes", "redundant_axes", "axes")


@query(sql("facts", _SPLIT))
def split_half(t: Tables) -> DataFrame:
    """Reliability of product means over random halvings."""
    return _halves(t)


@query(sql("facts", f"SELECT aspect, spearman_brown, {_VERDICT.format(v='spearman_brown')} AS verdict FROM (SPLIT)").replace("WITH facts", "WITH facts").replace("(SPLIT)", f"({_SPLIT})"))
def reliability_verdicts(t: Tables) -> DataFrame:
    return _verdicts(t)


_N1, _N2 = (f"greatest({uniform(repr('KEY'), s)},1e-12)".replace("CAST('KEY' AS VARCHAR)", "aspect||'-'||CAST(i AS VARCHAR)||'-'||CAST(p AS VARCHAR)") for s in ("n1", "n2"))
_NULL = f"ap AS (SELECT aspect, CAST(round(avg(n)) AS BIGINT) AS m, count(*) AS products, sqrt(avg(var)) AS s, stddev_samp(mean) AS observed_std FROM cells WHERE n>=10 GROUP BY 1), d AS (SELECT aspect, p, avg(5.5e0+s*sqrt(-2*ln({_N1}))*cos(2*pi()*{_N2})) AS mu FROM (SELECT aspect, s, m, p, unnest(range(m)) AS i FROM (SELECT aspect, s, m, unnest(range(products)) AS p FROM ap)) GROUP BY 1,2), ns AS (SELECT aspect, max(mu)-min(mu) AS null_range, stddev_pop(mu) AS null_std, quantile_cont(mu,0.9)-quantile_cont(mu,0.1) AS null_p90_p10 FROM d GROUP BY 1)"


@query(sql("cells", f"WITH {_NULL} SELECT aspect, round(null_range,6) AS null_range, round(null_std,6) AS null_std, round(null_p90_p10,6) AS null_p90_p10 FROM ns"))
def null_spread(t: Tables) -> DataFrame:
    """Spread of product means if only noise made them differ."""
    return R.null_spread(t.facts, FLOOR).select("aspect", *(r6(c).alias(c) for c in ("null_range", "null_std", "null_p90_p10")))


@query(sql("cells", f"WITH {_NULL} SELECT ns.aspect AS aspect, round(observed_std,6) AS observed_std, round(null_std,6) AS null_std, round(observed_std/null_std,6) AS ratio, CASE WHEN observed_std/null_std>=3 THEN 'well above null' WHEN observed_std/null_std>=1.5 THEN 'above null' ELSE 'NOT ABOVE NULL' END AS verdict FROM ns JOIN ap ON ap.aspect=ns.aspect"))
def null_comparison(t: Tables) -> DataFrame:
    out = R.compare_to_null(t.facts, FLOOR)
    ratio = F.col("observed_std") / F.col("null_std")
    return out.select("aspect", r6("observed_std").alias("observed_std"), r6("null_std").alias("null_std"), r6(ratio).alias("ratio"), ladder(ratio, *NULL_RATIO).alias("verdict"))


@query(sql("cells", f"WITH {_HALVES}, rel AS (SELECT aspect, 2*avg(s)/(1+avg(s)) AS sb FROM c GROUP BY 1), {_STARS.replace('c AS', 'c2 AS').replace('FROM c JOIN', 'FROM c2 JOIN').replace('ON s.model_key=c.', 'ON s.model_key=c2.').replace('r AS (SELECT *', 'r2 AS (SELECT *')}, st AS (SELECT aspect, corr(x,y)*corr(x,y) AS r2 FROM j GROUP BY 1) SELECT CASE WHEN sum(CASE WHEN sb>=0.6 THEN 1 ELSE 0 END)=0 THEN 'FAIL' WHEN sum(CASE WHEN r2>=0.9 THEN 1 ELSE 0 END)>0 THEN 'PARTIAL' ELSE 'PASS' END AS verdict, CAST(sum(CASE WHEN sb>=0.6 THEN 1 ELSE 0 END) AS BIGINT) AS usable_axes, CAST(sum(CASE WHEN r2>=0.9 THEN 1 ELSE 0 END) AS BIGINT) AS redundant_axes, count(*) AS axes FROM rel JOIN st ON st.aspect=rel.aspect"))
def gate_verdict(t: Tables) -> DataFrame:
    """Whether the profiles are fit to rank on."""
    return _gate(t)


_TRUTH = "1+9*least(15e0*(0.5e0+((3*CAST(model_key AS BIGINT)+5*(CASE aspect WHEN 'battery' THEN 0 WHEN 'camera' THEN 1 WHEN 'price' THEN 2 WHEN 'display' THEN 3 ELSE 4 END))%7)/6e0),100e0)/100e0"


@query(sql("long", f"WITH j AS (SELECT aspect, score AS x, {_TRUTH} AS y FROM long), r AS (SELECT *, rank() OVER (PARTITION BY aspect ORDER BY x)+(count(*) OVER (PARTITION BY aspect,x)-1)/2e0 AS rx, rank() OVER (PARTITION BY aspect ORDER BY y)+(count(*) OVER (PARTITION BY aspect,y)-1)/2e0 AS ry FROM j) SELECT aspect, count(*) AS products, round(corr(x,y),6) AS pearson, round(corr(rx,ry),6) AS spearman, round(avg(abs(x-y)),6) AS mean_abs_gap, CASE WHEN corr(rx,ry)>=0.7 THEN 'recovered' WHEN corr(rx,ry)>=0.4 THEN 'partly recovered' ELSE 'not recovered' END AS verdict FROM r GROUP BY 1 HAVING count(*)>=5"))
def recovery_check(t: Tables) -> DataFrame:
    """Profiles against the latent product effect that made the scores."""
    place = sum((F.when(F.col("aspect") == a, o).otherwise(0) for a, o in (("camera", 1), ("price", 2), ("display", 3), ("performance", 4))), F.lit(0))
    truth = 1 + 9 * F.least(15.0 * (0.5 + ((3 * F.col("model_key").cast("long") + 5 * place) % 7) / 6.0), F.lit(100.0)) / 100
    out = R.agreement(t.long.select("aspect", F.col("score").alias("x"), truth.alias("y"))).where("products >= 5")
    return out.select("aspect", "products", *(r6(c).alias(c) for c in ("pearson", "spearman", "mean_abs_gap")), ladder(F.col("spearman"), *RECOVERY).alias("verdict"))


@query(sql("facts", "SELECT polarity, aspect, round(score,6) AS score, CASE WHEN score<1.75e0 THEN 'Extremely Negative' WHEN score<3.25e0 THEN 'Negative' WHEN score<4.75e0 THEN 'Slightly Negative' WHEN score<6.25e0 THEN 'Neutral' WHEN score<7.75e0 THEN 'Slightly Positive' WHEN score<9.25e0 THEN 'Positive' ELSE 'Extremely Positive' END AS label, review_id FROM facts"))
def score_label(t: Tables) -> DataFrame:
    return t.facts.select("polarity", "aspect", r6("score").alias("score"), S.score_label(F.col("score")).alias("label"), "review_id")


@query(sql("facts", "SELECT review_id, round(100*(least(greatest(score,1e0),10e0)-1)/9,6) AS percent, CASE WHEN score<=1 THEN 'any' WHEN score<=3 THEN 'not fussy' WHEN score<=5 THEN 'decent' WHEN score<=7 THEN 'good' WHEN score<=9 THEN 'very good' ELSE 'the best' END AS word FROM facts"))
def score_position(t: Tables) -> DataFrame:
    s = F.col("score")
    word = F.when(s <= 1, "any").when(s <= 3, "not fussy").when(s <= 5, "decent").when(s <= 7, "good").when(s <= 9, "very good").otherwise("the best")
    return t.facts.select("review_id", r6(100 * (F.least(F.greatest(s, F.lit(1.0)), F.lit(10.0)) - 1) / 9).alias("percent"), word.alias("word"))


@query(sql("wide", f"SELECT model_key, CASE WHEN match_percent>=95 THEN 'strong' WHEN match_percent>=80 THEN 'good' WHEN match_percent>=60 THEN 'fair' ELSE 'weak' END AS tone, CASE WHEN battery<=1 THEN 'any' WHEN battery<=3 THEN 'not fussy' WHEN battery<=5 THEN 'decent' WHEN battery<=7 THEN 'good' WHEN battery<=9 THEN 'very good' ELSE 'the best' END AS battery_word FROM ({_RANKED})"))
def requirement_label(t: Tables) -> DataFrame:
    out = M.matched(t.wide, [F.lit(REQUIREMENT[a]) for a in AXES])
    b = F.col("battery")
    word = F.when(b <= 1, "any").when(b <= 3, "not fussy").when(b <= 5, "decent").when(b <= 7, "good").when(b <= 9, "very good").otherwise("the best")
    return out.select("model_key", ladder(F.col("match_percent"), ((95, "strong"), (80, "good"), (60, "fair")), "weak").alias("tone"), word.alias("battery_word"))


@query(sql("", f"SELECT CAST(p_partkey AS VARCHAR) AS model_key, round({uniform('p_name', 'quality')},6) AS quality, CASE WHEN {uniform('p_partkey', 'polarity')}<0.06e0 THEN 'neutral' WHEN {uniform('p_partkey', 'polarity')}<0.06e0+0.94e0*(1-{uniform('p_name', 'quality')}) THEN 'negative' ELSE 'positive' END AS polarity FROM part"))
def latent_quality(t: Tables) -> DataFrame:
    """A quality from the product's name, and a polarity drawn in proportion."""
    q, u = hash_uniform(F.col("p_name"), "quality"), hash_uniform(F.col("p_partkey"), "polarity")
    return t.raw("part").select(F.col("p_partkey").cast("string").alias("model_key"), r6(q).alias("quality"), F.when(u < 0.06, "neutral").when(u < 0.06 + 0.94 * (1 - q), "negative").otherwise("positive").alias("polarity"))
