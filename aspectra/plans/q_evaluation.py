"""Queries on metrics, calibration, bootstrap and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.constants import BOOTSTRAP_DRAWS
from aspectra.functions import scores as S
from aspectra.functions.scores import r6, ratio0
from aspectra.operators import evaluation as E
from aspectra.plans.bindings import Tables, sql, uniform
from aspectra.plans.registry import query

_CM = "cm AS (SELECT y.v AS y, p.v AS pred, count(d.y) AS n FROM (SELECT unnest(range(3)) AS v) y CROSS JOIN (SELECT unnest(range(3)) AS v) p LEFT JOIN preds d ON d.y=y.v AND d.pred_a=p.v GROUP BY 1,2)"
_CLS = _CM + ", cls AS (SELECT label, support, tp, predicted, coalesce(tp/nullif(CAST(predicted AS DOUBLE),0),0) AS precision, coalesce(tp/nullif(CAST(support AS DOUBLE),0),0) AS recall FROM (SELECT y AS label, sum(n) AS support, sum(CASE WHEN y=pred THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1) a JOIN (SELECT pred AS label2, sum(n) AS predicted FROM cm GROUP BY 1) b ON label=label2), f AS (SELECT *, coalesce(2*precision*recall/nullif(precision+recall,0),0) AS f1 FROM cls)"


@query(sql("preds", f"WITH {_CM} SELECT CAST(y AS INTEGER) AS y, CAST(pred AS INTEGER) AS pred, n FROM cm"))
def confusion_matrix(t: Tables) -> DataFrame:
    return E.confusion(t.predictions, 3, "y", "pred_a")


@query(sql("preds", f"WITH {_CLS} SELECT CAST(label AS VARCHAR) AS label, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, CAST(support AS BIGINT) AS support FROM f UNION ALL SELECT 'all', round(sum(tp)/sum(support),6), round(avg(f1),6), round(sum(f1*support)/sum(support),6), CAST(sum(support) AS BIGINT) FROM f"))
def single_label_metrics(t: Tables) -> DataFrame:
    """A row for each label; in the row of all: accuracy, macro and weighted F1."""
    classes = E.class_metrics(E.confusion(t.predictions, 3, "y", "pred_a"))
    each = classes.select(F.col("label").cast("string").alias("label"), *(r6(c).alias(c) for c in ("precision", "recall", "f1")), "support")
    whole = E.summary_metrics(classes).select(F.lit("all").alias("label"), r6("accuracy").alias("precision"), r6("macro_f1").alias("recall"), r6("weighted_f1").alias("f1"), F.col("n").alias("support"))
    return each.unionByName(whole)


def _multi(t: Tables) -> DataFrame:
    seen = t.pairs.groupBy("review_id", "aspect").agg(F.max("confidence").alias("p"), F.max((F.col("polarity") != "neutral").cast("int")).alias("y"))
    return seen.select(F.col("review_id").alias("id"), F.col("aspect").alias("label"), "y", F.col("p").alias("score"))


_ML = "ml AS (SELECT review_id AS id, aspect AS label, max(CASE WHEN polarity<>'neutral' THEN 1 ELSE 0 END) AS y, max(confidence) AS score FROM pairs GROUP BY 1,2)"


@query(sql("pairs", f"WITH {_ML}, m AS (SELECT *, CASE WHEN score>=0.5e0 THEN 1 ELSE 0 END AS p FROM ml), l AS (SELECT label, sum(y*p) AS tp, sum(y) AS pos, sum(p) AS said FROM m GROUP BY 1), i AS (SELECT id, sum(y*p) AS tp, sum(y) AS pos, sum(p) AS said, min(CASE WHEN y=p THEN 1 ELSE 0 END) AS same FROM m GROUP BY 1) SELECT (SELECT round(avg(coalesce(2e0*tp/nullif(CAST(pos+said AS DOUBLE),0),0)),6) FROM l) AS macro_f1, (SELECT round(2e0*sum(tp)/sum(pos+said),6) FROM l) AS micro_f1, round(avg(coalesce(2e0*tp/nullif(CAST(pos+said AS DOUBLE),0),0)),6) AS samples_f1, round(avg(same),6) AS subset_accuracy, count(*) AS n FROM i"))
def multi_label_metrics(t: Tables) -> DataFrame:
    out = E.multi_label(_multi(t).withColumn("p", (F.col("score") >= 0.5).cast("int")))
    return out.select(*(r6(c).alias(c) for c in ("macro_f1", "micro_f1", "samples_f1", "subset_accuracy")), "n")


_SWEEP = f"WITH {_ML}, g AS (SELECT round(0.1e0+i*0.02e0,6) AS threshold FROM (SELECT unnest(range(41)) AS i)), s AS (SELECT threshold, sum(CASE WHEN score>=threshold THEN y ELSE 0 END) AS tp, sum(y) AS pos, sum(CASE WHEN score>=threshold THEN 1 ELSE 0 END) AS said FROM ml, g GROUP BY 1), f AS (SELECT threshold, 2e0*tp/(pos+said) AS f1 FROM s)"


@query(sql("pairs", f"{_SWEEP} SELECT threshold, round(f1,6) AS f1, row_number() OVER (ORDER BY round(f1,6) DESC, threshold)=1 AS best FROM f"))
def tune_threshold(t: Tables) -> DataFrame:
    """Micro F1 over the grid of thresholds; the first best wins."""
    swept = E.threshold_sweep(_multi(t).withColumnRenamed("score", "p"), E.grid(t.spark, 0.1, 0.02, 41))
    out = swept.select("threshold", r6("f1").alias("f1"))
    top = out.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"))
    return out.crossJoin(F.broadcast(top)).select("threshold", "f1", (F.col("threshold") == F.col("t")).alias("best"))


@query(sql("pairs", "SELECT review_id FROM pairs GROUP BY 1 HAVING count(DISTINCT polarity)>1"))
def mixed_review_ids(t: Tables) -> DataFrame:
    return t.pairs.groupBy("review_id").agg(F.count_distinct("polarity").alias("n")).where("n > 1").select("review_id")


_MIX = "mix AS (SELECT review_id FROM pairs GROUP BY 1 HAVING count(DISTINCT polarity)>1)"


@query(sql("pairs", f"WITH {_MIX} SELECT mixed, count(*) AS pairs, count(DISTINCT review_id) AS reviews FROM (SELECT *, review_id IN (SELECT review_id FROM mix) AS mixed FROM pairs) GROUP BY 1"))
def mixed_vs_uniform(t: Tables) -> DataFrame:
    ids = mixed_review_ids(t)
    mixed = t.pairs.join(ids, "review_id", "left_semi").withColumn("mixed", F.lit(True))
    uniform_ = t.pairs.join(ids, "review_id", "left_anti").withColumn("mixed", F.lit(False))
    return mixed.unionByName(uniform_).groupBy("mixed").agg(F.count("*").alias("pairs"), F.count_distinct("review_id").alias("reviews"))


@query(sql("pairs", f"WITH {_MIX} SELECT review_id, aspect, position, CASE WHEN review_id IN (SELECT review_id FROM mix) THEN 5e0 ELSE 1e0 END AS weight FROM pairs"))
def mixed_weights(t: Tables) -> DataFrame:
    ids = mixed_review_ids(t).withColumn("mixed", F.lit(True))
    return t.pairs.join(ids, "review_id", "left").select("review_id", "aspect", "position", F.when(F.col("mixed"), 5.0).otherwise(1.0).alias("weight"))


_DIAG = "pp AS (SELECT p.review_id AS rid, d.y AS y, d.pred_a AS pa FROM preds d JOIN pairs p ON p.position=d.review_id), mx AS (SELECT rid, count(DISTINCT y)>1 AS mixed, count(DISTINCT pa)=1 AS flat FROM pp GROUP BY 1)"


@query(sql("preds pairs", f"WITH {_DIAG} SELECT round(avg(CASE WHEN mixed THEN CAST(y=pa AS DOUBLE) END),6) AS mixed_accuracy, round(avg(CASE WHEN NOT mixed THEN CAST(y=pa AS DOUBLE) END),6) AS uniform_accuracy, round(avg(CASE WHEN NOT mixed THEN CAST(y=pa AS DOUBLE) END)-avg(CASE WHEN mixed THEN CAST(y=pa AS DOUBLE) END),6) AS gap, (SELECT round(avg(CAST(flat AS DOUBLE)),6) FROM mx WHERE mixed) AS collapsed FROM pp JOIN mx ON mx.rid=pp.rid"))
def mixed_diagnostic(t: Tables) -> DataFrame:
    """Accuracy on reviews with several polarities against the rest, and how often answers collapse to one."""
    pp = t.predictions.select(F.col("review_id").alias("position"), "y", "pred_a").join(t.pairs.select("position", F.col("review_id").alias("rid")), "position")
    groups = pp.groupBy("rid").agg(F.sum((F.col("y") == F.col("pred_a")).cast("long")).alias("right"), F.count("*").alias("n"), (F.count_distinct("y") > 1).alias("mixed"), (F.count_distinct("pred_a") == 1).alias("flat"))
    pick = lambda c, m: F.sum(F.when(F.col("mixed") == m, F.col(c)))
    out = groups.agg((pick("right", True) / pick("n", True)).alias("mixed_accuracy"), (pick("right", False) / pick("n", False)).alias("uniform_accuracy"), F.avg(F.when(F.col("mixed"), F.col("flat").cast("double"))).alias("collapsed"))
    return out.select(r6("mixed_accuracy").alias("mixed_accuracy"), r6("uniform_accuracy").alias("uniform_accuracy"), r6(F.col("uniform_accuracy") - F.col("mixed_accuracy")).alias("gap"), r6("collapsed").alias("collapsed"))


_GOLD = "gold AS (SELECT review_id, aspect, max(polarity) AS polarity FROM pairs GROUP BY 1,2), said AS (SELECT review_id, aspect, min(polarity) AS polarity FROM pairs WHERE confidence>=0.3e0 GROUP BY 1,2)"


@query(sql("pairs", f"WITH {_GOLD} SELECT round(count(s.aspect)/CAST(count(*) AS DOUBLE),6) AS detection_recall, round(coalesce(sum(CASE WHEN s.polarity=g.polarity THEN 1 ELSE 0 END)/nullif(CAST(count(s.aspect) AS DOUBLE),0),0),6) AS accuracy, count(*) AS gold FROM gold g LEFT JOIN said s ON s.review_id=g.review_id AND s.aspect=g.aspect"))
def mode_eval(t: Tables) -> DataFrame:
    """Gold aspects against those found: recall, and accuracy among the found."""
    gold = t.pairs.groupBy("review_id", "aspect").agg(F.max("polarity").alias("gold"))
    said = t.pairs.where("confidence >= 0.3").groupBy("review_id", "aspect").agg(F.min("polarity").alias("said"))
    out = gold.join(said, ["review_id", "aspect"], "left").agg(F.count("said").alias("found"), F.count("*").alias("n"), F.sum((F.col("gold") == F.col("said")).cast("long")).alias("right"))
    return out.select(r6(ratio0(F.col("found"), F.col("n"))).alias("detection_recall"), r6(ratio0(F.col("right"), F.col("found"))).alias("accuracy"), F.col("n").alias("gold"))


_CONF = "(SELECT *, greatest(p_negative,p_neutral,p_positive) AS c, CASE WHEN p_negative=greatest(p_negative,p_neutral,p_positive) THEN 0 WHEN p_neutral=greatest(p_negative,p_neutral,p_positive) THEN 1 ELSE 2 END AS top FROM probs)"


def _confidence(t: Tables) -> DataFrame:
    p = [F.col(c) for c in ("p_negative", "p_neutral", "p_positive")]
    out = t.probs.withColumn("c", F.greatest(*p))
    return out.withColumn("top", F.when(p[0] == F.col("c"), 0).when(p[1] == F.col("c"), 1).otherwise(2))


@query(sql("probs", f"SELECT round(sum(n*abs(a-m))/sum(n),6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT ceil(c*10)-1 AS b, count(*) AS n, avg(CAST(top=y AS DOUBLE)) AS a, avg(c) AS m FROM {_CONF} WHERE c>0 GROUP BY 1)"))
def ece(t: Tables) -> DataFrame:
    out = E.ece(E.ece_bins(_confidence(t), "c", F.col("top") == F.col("y")))
    return out.select(r6("ece").alias("ece"), "n")


@query(sql("probs", f"SELECT round(avg(CASE WHEN top<>y AND c>0.7e0 THEN 1e0 ELSE 0e0 END),6) AS rate, count(*) AS n FROM {_CONF}"))
def confidently_wrong(t: Tables) -> DataFrame:
    out = E.confidently_wrong(_confidence(t), "c", F.col("top") == F.col("y"))
    return out.select(r6("rate").alias("rate"), "n")


def _nll_sql(grid: str) -> str:
    e = [f"exp((l{i}-greatest(l0,l1,l2))/t)" for i in range(3)]
    return f"SELECT t, round(avg(-ln(greatest((CASE y WHEN 0 THEN {e[0]} WHEN 1 THEN {e[1]} ELSE {e[2]} END)/({'+'.join(e)}),1e-12))),6) AS nll FROM probs, {grid} GROUP BY 1"


@query(sql("probs", _nll_sql("(SELECT 1e0 AS t)")))
def nll_at_t(t: Tables) -> DataFrame:
    return E.nll(t.probs, ["l0", "l1", "l2"], "y", t.spark.createDataFrame([(1.0,)], "t double")).select("t", r6("nll").alias("nll"))


@query(sql("probs", _nll_sql("(SELECT round(0.25e0+i*0.25e0,6) AS t FROM (SELECT unnest(range(20)) AS i))")))
def nll_grid(t: Tables) -> DataFrame:
    """The loss at each temperature of a grid, in one pass."""
    return E.nll(t.probs, ["l0", "l1", "l2"], "y", E.grid(t.spark, 0.25, 0.25, 20, "t")).select("t", r6("nll").alias("nll"))


def _draws_sql(sums: str, difference: str) -> str:
    """The interval of a difference over all draws: every row's weight in every draw, by the same mixed bits."""
    bits = lambda key, seed: f"CAST(('0x'||substr(md5(CAST({key} AS VARCHAR)||'|{seed}'),1,8)) AS UBIGINT)"
    x = "x0"
    steps = []
    for i, (shift, factor) in enumerate(((16, E.MIX[0]), (13, E.MIX[1]), (16, 1))):
        steps.append(f"SELECT * EXCLUDE ({x}), (xor({x},{x}>>{shift})*CAST({factor} AS UBIGINT))%CAST(4294967296 AS UBIGINT) AS x{i + 1} FROM")
        x = f"x{i + 1}"
    mixed = f"(SELECT draw, y, pred_a, pred_b, xor(h,hd) AS x0 FROM (SELECT {bits('review_id', 'boot')} AS h, y, pred_a, pred_b FROM preds), (SELECT i AS draw, {bits('i', 'draw')} AS hd FROM (SELECT unnest(range({BOOTSTRAP_DRAWS})) AS i)))"
    for step in steps:
        mixed = f"({step} {mixed})"
    weight = "+".join(f"CAST(x3/4294967296e0>={e!r}e0 AS INTEGER)" for e in E.POISSON)
    drawn = f"SELECT draw, {difference} AS diff FROM (SELECT draw, {sums} FROM (SELECT draw, y, pred_a, pred_b, {weight} AS w FROM {mixed}) GROUP BY 1)"
    return f"SELECT round(lower,6) AS lower, round(upper,6) AS upper, round(mean_diff,6) AS mean_diff, draws, CASE WHEN lower<=0 AND upper>=0 THEN 'no difference' WHEN lower>0 THEN 'better' ELSE 'worse' END AS verdict FROM (SELECT quantile_cont(diff,0.025) AS lower, quantile_cont(diff,0.975) AS upper, avg(diff) AS mean_diff, count(*) AS draws FROM ({drawn}))"


def _interval(draws: DataFrame) -> DataFrame:
    return E.interval(draws).select(*(r6(c).alias(c) for c in ("lower", "upper", "mean_diff")), "draws", "verdict")


_ALL_RIGHT = "sum(w) AS n, sum(CASE WHEN pred_a=y THEN w ELSE 0 END) AS a, sum(CASE WHEN pred_b=y THEN w ELSE 0 END) AS b"
_BY_CLASS = ", ".join(f"sum(CASE WHEN y={k} THEN w ELSE 0 END) AS y{k}, " + ", ".join(f"sum(CASE WHEN {p}={k} THEN w ELSE 0 END) AS {p}{k}, sum(CASE WHEN {p}={k} AND y={k} THEN w ELSE 0 END) AS {p}{k}r" for p in ("pred_a", "pred_b")) for k in range(3))
_F1S = "(" + "+".join(f"coalesce(2e0*pred_b{k}r/nullif(CAST(y{k}+pred_b{k} AS DOUBLE),0),0)-coalesce(2e0*pred_a{k}r/nullif(CAST(y{k}+pred_a{k} AS DOUBLE),0),0)" for k in range(3)) + ")/3e0"


@query(sql("preds", _draws_sql(_ALL_RIGHT, "(b-a)/CAST(n AS DOUBLE)")))
def paired_bootstrap(t: Tables) -> DataFrame:
    """Interval of the difference of two models' accuracy over 5000 draws of all rows."""
    return _interval(E.bootstrap(t.predictions, "review_id", "y", "pred_a", "pred_b"))


@query(sql("preds", _draws_sql(_BY_CLASS, _F1S)))
def paired_bootstrap_f1(t: Tables) -> DataFrame:
    """The same of macro F1."""
    return _interval(E.bootstrap(t.predictions, "review_id", "y", "pred_a", "pred_b", E.macro_f1(3)))


@query(sql("preds", "SELECT label, n, round((1e0/n)/avg(1e0/n) OVER (),6) AS weight FROM (SELECT CAST(y AS INTEGER) AS label, count(*) AS n FROM preds GROUP BY 1)"))
def class_weights(t: Tables) -> DataFrame:
    return E.class_weights(t.predictions, "y").select("label", "n", r6("weight").alias("weight"))


@query(sql("facts", "SELECT aspect AS label, round(greatest(0.1e0,least(20e0,(count(*)-sum(CAST(polarity='positive' AS BIGINT)))/CAST(greatest(sum(CAST(polarity='positive' AS BIGINT)),1) AS DOUBLE))),6) AS weight FROM facts GROUP BY 1"))
def pos_weights(t: Tables) -> DataFrame:
    return E.pos_weights(t.facts, "aspect", F.col("polarity") == "positive").select("label", r6("weight").alias("weight"))


_SEEDS = f"(SELECT seed, share, avg(CASE WHEN {uniform('K', 'sweep').replace('CAST(K AS VARCHAR)', 'key')}<share THEN 1e0-ok ELSE ok END) AS metric FROM (SELECT CAST(review_id AS VARCHAR)||'-'||CAST(seed AS VARCHAR)||'-'||CAST(sh AS VARCHAR) AS key, seed, sh/10e0 AS share, CAST(pred_b=y AS DOUBLE) AS ok FROM preds, (SELECT unnest(range(4)) AS seed), (SELECT unnest(range(4)) AS sh)) GROUP BY 1,2)"


def _sweep(t: Tables) -> DataFrame:
    """A metric for each seed and setting: the sweep's records."""
    seeds = t.spark.range(4).select(F.col("id").alias("seed"))
    shares = t.spark.range(4).select(F.col("id").alias("sh"))
    at = t.predictions.select("review_id", (F.col("pred_b") == F.col("y")).cast("double").alias("ok")).crossJoin(F.broadcast(seeds.crossJoin(shares)))
    u = S.hash_uniform(F.concat_ws("-", F.col("review_id").cast("string"), F.col("seed").cast("string"), F.col("sh").cast("string")), "sweep")
    share = F.col("sh") / 10
    return at.groupBy("seed", share.alias("share")).agg(F.avg(F.when(u < share, 1 - F.col("ok")).otherwise(F.col("ok"))).alias("metric"))


@query(sql("preds", f"SELECT round(share,6) AS share, round(avg(metric),6) AS mean_metric, round(stddev_samp(metric),6) AS sd, abs(avg(metric)-max(base))<2*stddev_samp(metric) AS within_noise FROM (SELECT *, avg(CASE WHEN share=0 THEN metric END) OVER () AS base FROM {_SEEDS}) GROUP BY 1"))
def seed_sweep(t: Tables) -> DataFrame:
    """Mean and spread over seeds, and whether a setting differs from the first by more than noise."""
    each = _sweep(t)
    base = each.where("share = 0").agg(F.avg("metric").alias("base"))
    out = each.groupBy("share").agg(F.avg("metric").alias("m"), F.stddev_samp("metric").alias("sd")).crossJoin(F.broadcast(base))
    return out.select(r6("share").alias("share"), r6("m").alias("mean_metric"), r6("sd").alias("sd"), (F.abs(F.col("m") - F.col("base")) < 2 * F.col("sd")).alias("within_noise"))


@query(sql("preds", f"SELECT seed, round(share,6) AS share, round(metric,6) AS metric FROM {_SEEDS} ORDER BY round(metric,6) DESC, share, seed LIMIT 1"))
def select_best(t: Tables) -> DataFrame:
    out = _sweep(t).select("seed", r6("share").alias("share"), r6("metric").alias("metric"))
    return E.best_first(out, F.desc("metric"), F.col("share"), F.col("seed"))


@query(sql("preds", f"SELECT round(share,6) AS share, round(m-2*greatest(0,base-lo),6) AS penalised FROM (SELECT share, avg(metric) AS m, min(metric) AS lo, avg(base) AS base FROM (SELECT *, avg(CASE WHEN share=0 THEN metric END) OVER () AS base FROM {_SEEDS}) GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 1"))
def select_penalised(t: Tables) -> DataFrame:
    """The best mean less a penalty for falling under the base."""
    each = _sweep(t)
    base = each.where("share = 0").agg(F.avg("metric").alias("base"))
    out = each.groupBy("share").agg(F.avg("metric").alias("m"), F.min("metric").alias("lo")).crossJoin(F.broadcast(base))
    out = out.select(r6("share").alias("share"), r6(F.col("m") - 2 * F.greatest(F.lit(0.0), F.col("base") - F.col("lo"))).alias("penalised"))
    return E.best_first(out, F.desc("penalised"), F.col("share"))


@query(sql("probs", "SELECT vec_id, " + ", ".join(f"round({c},6) AS {c}" for c in ("p_negative", "p_neutral", "p_positive")) + " FROM probs"))
def softmax_probs(t: Tables) -> DataFrame:
    return t.probs.select("vec_id", *(r6(c).alias(c) for c in ("p_negative", "p_neutral", "p_positive")))


@query(sql("probs", "SELECT vec_id, round(0.5e0*p_neutral+p_positive,6) AS positivity, round(1+9*(0.5e0*p_neutral+p_positive),6) AS score FROM probs"))
def score_from_probs(t: Tables) -> DataFrame:
    p = [F.col(c) for c in ("p_negative", "p_neutral", "p_positive")]
    return t.probs.select("vec_id", r6(S.positivity(p)).alias("positivity"), r6(S.to_score(p)).alias("score"))


@query(sql("probs", f"SELECT vec_id, CASE top WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS polarity, round(c,6) AS confidence, round(s,6) AS score, CASE WHEN s<1.75e0 THEN 'Extremely Negative' WHEN s<3.25e0 THEN 'Negative' WHEN s<4.75e0 THEN 'Slightly Negative' WHEN s<6.25e0 THEN 'Neutral' WHEN s<7.75e0 THEN 'Slightly Positive' WHEN s<9.25e0 THEN 'Positive' ELSE 'Extremely Positive' END AS label FROM (SELECT *, 1+9*(0.5e0*p_neutral+p_positive) AS s FROM {_CONF})"))
def build_score(t: Tables) -> DataFrame:
    p = [F.col(c) for c in ("p_negative", "p_neutral", "p_positive")]
    score = S.to_score(p)
    return t.probs.select("vec_id", S.first_max(p).alias("polarity"), r6(F.greatest(*p)).alias("confidence"), r6(score).alias("score"), S.score_label(score).alias("label"))
