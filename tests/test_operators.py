from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aspectra.constants import AXES
from aspectra.operators import analysis, catalog, dataset, evaluation, profiles, recommend


def test_shrinkage_pulls_small_samples_further(spark):
    rows = [("a", f"r{i}", "battery", 9.0 + (i % 2), 0.5) for i in range(40)] + [("b", f"s{i}", "battery", 9.0 + (i % 2), 0.5) for i in range(4)] + [("c", f"t{i}", "battery", 2.0 + (i % 2), 0.5) for i in range(40)]
    facts = spark.createDataFrame(rows, "model_key string, review_id string, aspect string, score double, confidence double")
    got = {r.model_key: r for r in profiles.profiles_long(facts, 2).collect()}
    assert got["a"].raw_score == got["b"].raw_score
    assert got["b"].score < got["a"].score < got["a"].raw_score
    assert profiles.profiles_long(facts, 5).count() == 2


def test_no_variance_between_products_gives_the_grand_mean(spark):
    rows = [(k, f"{k}{i}", "battery", 4.0 + i, 0.5) for k in "abc" for i in range(3)]
    facts = spark.createDataFrame(rows, "model_key string, review_id string, aspect string, score double, confidence double")
    assert profiles.shrinkage_params(profiles.cell_means(facts)).first().k is None
    assert {r.score for r in profiles.profiles_long(facts, 1).collect()} == {5.0}


def test_rank_prefers_no_shortfall_and_limit_zero_is_all(spark):
    rows = [("good", *[9.0] * 5), ("weak", 2.0, 9.0, 9.0, 9.0, 9.0), ("bad", *[1.0] * 5)]
    wide = spark.createDataFrame(rows, "model_key string, " + ", ".join(f"{a} double" for a in AXES))
    need = dict.fromkeys(AXES, 7.0)
    got = [(r.model_key, r.worst_axis) for r in recommend.rank(wide, need, 0).orderBy("rank").collect()]
    assert got == [("good", None), ("weak", "battery"), ("bad", "battery")]
    assert recommend.rank(wide, need, 1).count() == 1
    with pytest.raises(ValueError):
        recommend.rank(wide, {"battery": 3.0})
    with pytest.raises(ValueError):
        recommend.rank(wide, dict.fromkeys(AXES, 11.0))


def test_search_takes_wildcards_as_text(spark):
    rows = [("a", "50% off", "X", 0, 3), ("b", "500 off", "x", 1, 5)]
    products = spark.createDataFrame(rows, "model_key string, name string, brand string, simulated int, reviews_total int")
    assert [r.model_key for r in recommend.search(products, "0% o").collect()] == ["a"]
    assert [(r.model_key, r.total) for r in recommend.search(products, brand="X", limit=1, offset=1).collect()] == [("a", 2)]
    assert recommend.search(products, include_simulated=False).count() == 1


def test_majority_vote_breaks_ties_among_the_tied(spark):
    rows = [("r", "a", p) for p in ("positive", "positive", "negative", "negative", "neutral")] + [("r", "b", "positive"), ("r", "b", "neutral")]
    got = {r.aspect: (r.polarity, r.all_tied) for r in dataset.majority_vote(spark.createDataFrame(rows, "review_id string, aspect string, polarity string"), ["review_id", "aspect"]).collect()}
    assert got == {"a": ("negative", False), "b": ("neutral", True)}


def test_lines_are_parsed_or_rejected_by_cause(spark):
    lines = ["good####[['a', 'Overall', 'positive']]", "none", "####[]", "x####(1,2)", "x####[oops]", "x####[['a', 'b']]", "x####[]"]
    got = {r.value: r.reject for r in dataset.parse_lines(spark.createDataFrame([(v,) for v in lines], "value string")).collect()}
    assert [got[v] for v in lines] == [None, "no separator", "empty text", "not a list", "unreadable", "wrong shape", None]


def test_unknown_categories_fail_loudly(spark):
    df = spark.createDataFrame([("Screen#X", "phone"), ("Odd", "phone")], "category string, domain string")
    aspect, state = dataset.map_category(F.col("category"), F.col("domain"))
    mapped = df.withColumns({"aspect": aspect, "state": state})
    with pytest.raises(Exception, match="unmapped category Odd"):
        dataset.require_mapped(mapped).collect()


def test_test_split_wins_and_leaks_are_found(spark):
    rows = spark.createDataFrame([("b", "k", "train"), ("a", "k", "test"), ("c", "z", "dev")], "id string, k string, split string")
    got = {(r.k, r.split, r.canonical_id) for r in dataset.dedupe_across_splits(rows, "k", "id").collect()}
    assert got == {("k", "test", "a"), ("z", "dev", "c")}
    with pytest.raises(ValueError):
        dataset.assert_no_leakage(rows, "k")


def test_primary_listing_takes_each_column_for_itself(spark):
    listings = spark.createDataFrame([(1, "n1", "x", None, "k"), (2, "n2", "x", "img", "k")], "asin int, name string, brand string, image string, model_key string")
    reviews = spark.createDataFrame([(1,), (1,), (2,)], "asin int")
    r = catalog.primary_listing(listings, reviews).first()
    assert (r.asin, r.name, r.image) == (1, "n1", "img")


def test_numbers_are_consecutive_over_partitions(spark):
    df = spark.range(1000).repartition(7)
    got = catalog.enumerate_rows(df, "id", "n").orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_blank_texts_have_no_words(spark):
    df = spark.createDataFrame([("",), ("  ",), ("a b",), (None,)], "t string")
    assert [r.n for r in df.select(catalog.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 2, None]


def test_scorer_falls_back_to_the_whole_review(spark):
    units = spark.createDataFrame([("r", 0, "nothing here", "nothing here at all"), ("s", 0, "the battery is bad", "x"), ("s", 1, "good battery and camera", "x")], "review_id string, position int, unit string, cleaned string")
    got = analysis.analyze(units, list(AXES), analysis.keyword_detector({"battery": "battery", "camera": "camera"}), analysis.keyword_classifier("bad", "good"))
    rows = {(r.review_id, r.aspect): r for r in got.collect()}
    assert set(rows) == {("r", "battery"), ("s", "battery"), ("s", "camera")}
    assert rows["s", "battery"].mentions == 2
    assert rows["s", "battery"].score == pytest.approx(1 + 9 * (0.5 * 0.05 + (0.05 + 0.90) / 2))
    assert rows["s", "camera"].polarity == "positive"


def test_statuses(spark):
    df = spark.createDataFrame([("",), ("1",), ("x" * 5001,), ("fine text",), (None,)], "text string")
    assert [r.state for r in analysis.statuses(df).collect()] == ["blank", "unusable", "too_long", "ok", "blank"]


def test_temperature_of_overconfident_logits_is_above_one(spark):
    rows = [(i, 8.0, 0.0, 0.0, 0 if i % 10 < 7 else 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, l0 double, l1 double, l2 double, y int")
    assert evaluation.fit_temperature(df, ["l0", "l1", "l2"], "y", tolerance=0.01) > 2


def test_equal_models_differ_by_nothing(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, i % 2) for i in range(50)], "id int, y int, a int, b int")
    r = evaluation.interval(evaluation.bootstrap(df, "id", "y", "a", "b", draws=20)).first()
    assert (r.lower, r.upper, r.verdict) == (0.0, 0.0, "no difference")


def test_absent_classes_stay_in_the_matrix(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, pred int")
    m = evaluation.confusion(df, 3)
    assert m.count() == 9
    assert [r.f1 for r in evaluation.class_metrics(m).orderBy("label").collect()][2] == 0.0


def test_disjoint_sets_cover_all_rows_and_pairs(spark):
    """Against all pairs: reviews of different blocks, and a common aspect on a row that is no 40th one."""
    data = [("10-a", "price", 0), ("10-b", "battery", 40), ("10-b", "price", 41), ("20-c", "camera", 3), ("20-c", "camera", 5), ("30-d", "battery", 7), ("30-e", "battery", 80)]
    said = spark.createDataFrame(data, "review_id string, aspect string, position long")
    sets = dataset.aspect_sets(said)
    members = {r.review_id: r.aspects for r in sets.collect()}
    of = lambda s: {i for i, own in members.items() if own == s}
    rows = dataset.disjoint_sets(sets).collect()
    got = {tuple(sorted((x, y))) for r in rows for x in of(r.a) for y in of(r.b)}
    brute = {i: {a for j, a, _ in data if j == i} for i, *_ in data}
    assert got == {(x, y) for x in brute for y in brute if x < y and not brute[x] & brute[y]}
    assert sum(r.pairs for r in rows) == len(got)
    assert ("10-a", "20-c") in got and ("10-a", "10-b") not in got


def test_resampling_is_whole(spark):
    """The reference's numbers of draws and repeats, and its interval by numpy."""
    import numpy as np

    from aspectra.operators import reliability

    rng = np.random.default_rng(2)
    a, b = rng.random(300) < 0.70, rng.random(300) < 0.75
    df = spark.createDataFrame([(i, 1, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))], "id int, y int, a int, b int")
    got = evaluation.interval(evaluation.bootstrap(df, "id", "y", "a", "b")).first()
    d = b.astype(int) - a.astype(int)
    want = np.percentile([d[rng.integers(0, 300, 300)].mean() for _ in range(5000)], [2.5, 97.5])
    assert got.draws == 5000
    assert (got.lower, got.upper) == pytest.approx(tuple(want), abs=0.008)
    assert evaluation.bootstrap(df.limit(0), "id", "y", "a", "b").count() == 0
    rows = [(f"m{k}", f"r{k}-{i}", "battery", float(rng.normal(k, 2))) for k in range(8) for i in range(12)]
    facts = spark.createDataFrame(rows, "model_key string, review_id string, aspect string, score double")
    assert reliability.split_half(facts, 10).collect() == reliability.split_half(facts, 10, 25).collect() != reliability.split_half(facts, 10, 5).collect()


def test_ranks_by_counts_are_those_by_rows(spark):
    from pyspark.sql import Window

    from aspectra.operators import reliability

    rows = [(i, ("a", "b", None)[i % 3], None if i % 11 == 0 else float(i * i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    own = Window.partitionBy("g")
    want = df.withColumn("place", F.rank().over(own.orderBy("v")) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2)
    got = {r.id: r.place for r in reliability.average_rank(df, "g", "v", "place").collect()}
    assert got == {r.id: r.place for r in want.collect()} and len(got) == 300


def test_halves_of_large_cells_are_those_of_small_ones(spark):
    """Cells that meet in no task give the halves of those that do."""
    import numpy as np

    from aspectra.operators import reliability

    rng = np.random.default_rng(4)
    rows = [(f"m{k}", "battery", f"r{k}-{i}", float(rng.normal(k, 2))) for k in range(5) for i in range(13 + 40 * k)]
    rows += [("m9", "price", f"x{i}", 1.0) for i in range(7)]
    df = spark.createDataFrame(rows, "model_key string, aspect string, review_id string, score double").repartition(3)
    small = {(r.model_key, r.aspect, r.i): (r.a, r.b) for r in reliability._small_halves(df, 10, 4).collect()}
    sizes = df.groupBy("model_key", "aspect").agg(F.count("*").alias("n")).where("n >= 10")
    large = {(r.model_key, r.aspect, r.i): (r.a, r.b) for r in reliability._large_halves(df.where("aspect = 'battery'"), sizes, 4).collect()}
    assert set(small) == set(large) and len(small) == 20
    assert all(large[c] == pytest.approx(small[c]) for c in small)
    both = reliability.split_half(df, 10, 4).first()
    assert reliability.split_half(df, 10, 4, large=60).first().asDict() == pytest.approx(both.asDict())


def test_bootstrap_of_any_metric(spark):
    """Against sums over rows with the weights of their bits, in any dealing; tasks send a row for each draw."""
    import hashlib

    import numpy as np

    rows = [(i, i % 3, i % 3 if i % 4 else 0, i % 3 if i % 5 else 1) for i in range(90)]
    df = spark.createDataFrame([*rows, (None, 1, None, 1)], "id int, y int, a int, b int").where("id is not null").repartition(3)
    ids = np.array([int(hashlib.md5(f"{r[0]}|boot".encode()).hexdigest()[:8], 16) for r in rows])
    weights = evaluation.draw_weights(ids, np.array([evaluation.draw_bits(d) for d in range(300)]))
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    assert abs(np.corrcoef(weights[:, :40].T.astype(float))[np.triu_indices(40, 1)].mean()) < 0.02

    def f1(pred, draw):
        parts = []
        for k in range(4):
            hit = sum(w for r, w in zip(rows, weights[:, draw].tolist()) if r[1] == k and r[pred] == k)
            every = sum(w * ((r[1] == k) + (r[pred] == k)) for r, w in zip(rows, weights[:, draw].tolist()))
            parts.append(2 * hit / every if every else 0)
        return sum(parts) / 4

    right = lambda pred, draw: sum(w for r, w in zip(rows, weights[:, draw].tolist()) if r[1] == r[pred]) / int(weights[:, draw].sum())
    got = {r.draw: r["diff"] for r in evaluation.bootstrap(df, "id", "y", "a", "b", evaluation.macro_f1(4), 300).collect()}
    assert got == pytest.approx({d: f1(3, d) - f1(2, d) for d in range(300)})
    got = {r.draw: r["diff"] for r in evaluation.bootstrap(df, "id", "y", "a", "b", draws=300).collect()}
    assert got == pytest.approx({d: right(3, d) - right(2, d) for d in range(300)})


def test_synthetic_reviews_carry_their_labels(spark):
    import json

    from aspectra.operators.synthetic import reviews

    products = spark.createDataFrame([(f"k{i}", f"Phone {i}") for i in range(40)], "model_key string, name string")
    made = reviews(products, 25)
    got = made.collect()
    assert len(got) == 1000 and sorted(map(tuple, got)) == sorted(map(tuple, reviews(products.repartition(3), 25).collect()))
    sizes, polarities, cases = set(), set(), {"upper": 0, "lower": 0, "dots": 0}
    for r in got:
        labels, clauses = json.loads(r.labels), json.loads(r.clauses)
        assert labels.keys() == clauses.keys() and set(labels) <= set(AXES) and "{" not in r.text
        assert all(c.lower() in r.text.lower().replace("!", ".") or "." in c for c in clauses.values())
        sizes.add(len(labels))
        polarities |= set(labels.values())
        cases["upper"] += r.text.isupper()
        cases["lower"] += r.text.islower()
        cases["dots"] += r.text.endswith("...")
    assert sizes == {1, 2, 3} and polarities == {"positive", "neutral", "negative"}
    assert all(10 < n < 150 for n in cases.values())


def test_the_scorer_makes_its_units_once(spark):
    """Reviews that no unit is found in are scored as whole texts, without a second pass over the units."""
    from aspectra.operators import analysis as A

    made = spark.sparkContext.accumulator(0)

    def seen(unit):
        made.add(1)
        return unit

    data = [(i, k, ["the battery", "a price", "nothing"][(i + k) % 3] if i % 4 else "none", f"whole {i} camera" if i % 8 else "whole") for i in range(40) for k in range(3)]
    raw = spark.createDataFrame(data, "review_id int, position int, unit string, cleaned string")
    units = raw.withColumn("unit", F.udf(seen)("unit"))
    words = {"battery": "battery", "price": "price", "camera": "camera"}
    got = {(r.review_id, r.aspect): r.mentions for r in A.analyze(units, list(words), A.keyword_detector(words), A.keyword_classifier("bad", "good")).collect()}
    want = {}
    for i in range(40):
        said = [a for _, _, u, _ in data[3 * i : 3 * i + 3] for a in words if a in u]
        for a in said or (["camera"] if i % 8 else ["battery"]):
            want[i, a] = want.get((i, a), 0) + 1
    assert got == want and made.value == len(data)


def test_synthetic_reviews_are_made_by_all_cores(spark, tmp_path):
    """Parts of a single row group are dealt out before the reviews are made."""
    from aspectra.plans.bindings import Tables
    from aspectra.plans.q_text import synthetic_reviews

    parts = spark.range(4000).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit(1.0).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([], "event_id long, user_id long, event_type string, value double, props string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    out = synthetic_reviews(Tables(spark, str(tmp_path)))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12000 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 12000 / 2


def test_cells_are_halved_many_at_a_time_and_none_is_cut():
    """Tables of whole groups: far fewer than groups, whatever the batches."""
    import pyarrow as pa

    from aspectra.sources.shared import whole_runs

    keys = [f"k{i // 3:04d}" for i in range(900)]
    rows = pa.table({"cell": keys, "n": list(range(900))})
    for size in (1, 2, 100, 900):
        parts = list(whole_runs(iter(rows.to_batches(max_chunksize=size)), "cell"))
        assert pa.concat_tables(parts).to_pydict() == rows.to_pydict()
        ends = [(p.column("cell")[0].as_py(), p.column("cell")[-1].as_py()) for p in parts]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
        assert size < 100 or len(parts) <= 2 * 900 // size


def test_bootstrap_rows_are_dealt_over_all_cores(spark, monkeypatch):
    """Rows of a single partition are weighed by every core, and the sums are the same."""
    df = spark.range(300).select("id", (F.col("id") % 3).alias("x")).coalesce(1)
    seen = []
    own = evaluation.arrow_map

    def watched(rows, *more):
        seen.append(rows.rdd.getNumPartitions())
        return own(rows, *more)

    monkeypatch.setattr(evaluation, "arrow_map", watched)
    got = evaluation.bootstrap_sums(df, "id", [F.col("x")], draws=7).collect()
    assert seen == [max(seen[0], spark.sparkContext.defaultParallelism)]
    again = evaluation.bootstrap_sums(df.repartition(3), "id", [F.col("x")], draws=7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
