from __future__ import annotations

import random
import math

import pytest
from pyspark.sql import functions as F

from aspectra.functions import scores as S
from aspectra.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def texts(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_score_ends_and_middle(spark):
    p = lambda *x: [F.lit(float(v)) for v in x]
    assert one(spark, S.to_score(p(1, 0, 0))) == 1.0
    assert one(spark, S.to_score(p(0, 1, 0))) == 5.5
    assert one(spark, S.to_score(p(0, 0, 1))) == 10.0


@pytest.mark.parametrize(("score", "label"), [(0.5, "Extremely Negative"), (1.75, "Negative"), (5.5, "Neutral"), (6.25, "Slightly Positive"), (10.0, "Extremely Positive")])
def test_bands_include_their_lower_edge(spark, score, label):
    assert one(spark, S.score_label(F.lit(score))) == label


def test_price_score_is_clipped_inverted_and_degenerate(spark):
    lo, hi = F.lit(100.0), F.lit(1000.0)
    assert one(spark, S.price_to_score(F.lit(50.0), lo, hi)) == 10.0
    assert one(spark, S.price_to_score(F.lit(5000.0), lo, hi)) == pytest.approx(1.0)
    assert one(spark, S.price_to_score(F.lit(5.0), lo, lo)) == 5.5
    middle = one(spark, S.score_to_price(F.lit(5.5), lo, hi))
    assert middle == pytest.approx(math.sqrt(100 * 1000))


def test_match_is_whole_when_nothing_is_asked(spark):
    needs = [F.lit(1.0)] * 5
    assert one(spark, S.match_percent(needs, [F.lit(0.0)] * 5)) == 100.0
    assert one(spark, S.worst_axis([F.lit(0.0)] * 5)) is None
    assert one(spark, S.worst_axis([F.lit(x) for x in (0.0, 2.0, 2.0, 1.0, 0.0)])) == "camera"


def test_python_rounding(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (None,)], "x double")
    assert [r.v for r in df.select(X.python_round(2)("x").alias("v")).collect()] == [round(2.675, 2), round(0.125, 2), None]


def test_cleaning_keeps_wording(spark):
    got = texts(spark, X.clean_text, ["I don’t like it!!!!! <b>Bad</b>&amp;c", "see www.x.org or a@b.com", "nice… Read more. end", None, "  a\n\tb  "])
    assert got == ["I don't like it!! Bad &c", "see [URL] or [EMAIL]", "nice.. end", "", "a b"]


def test_full_cleaning_repairs_mojibake(spark):
    broken = "it’s".encode().decode("cp1252")
    assert texts(spark, X.clean_text_full, [broken, "ﬁne &eacute;"]) == ["it's", "fine é"]


def test_dedup_keys(spark):
    assert texts(spark, X.dedup_key_full, ["été!", "Straße", "!!", None]) == ["e te", "strasse", "", ""]
    assert texts(spark, X.dedup_key, ["A, b  C!"]) == ["a b c"]


@pytest.mark.parametrize(
    ("text", "units"),
    [
        (None, []),
        ("  ", []),
        ("It lasts all day long. The camera is grainy here.", ["It lasts all day long.", "The camera is grainy here."]),
        ("A 6.1 inch screen for $299.99 is fine.", ["A 6.1 inch screen for $299.99 is fine."]),
        ("Wow. It really works well.", ["Wow. It really works well."]),
        ("It works well indeed. Wow.", ["It works well indeed. Wow."]),
        ("Mr. Smith likes his phone. He uses it daily.", ["Mr. Smith likes his phone.", "He uses it daily."]),
        ("Pros:\n- great screen\n- weak battery", ["Pros:", "great screen", "weak battery"]),
        ("...", ["..."]),
    ],
)
def test_sentence_units(spark, text, units):
    assert texts(spark, X.split_sentences, [text]) == [units]


def test_long_units_are_cut_without_loss(spark):
    words = " ".join(f"w{i}" for i in range(140))
    commas = ", ".join(" ".join(["x"] * 25) for _ in range(4))
    tail = "a b, " + " ".join(["y"] * 120) + ", c d"
    long, clauses, mixed = texts(spark, X.split_sentences, [words, commas, tail])
    assert [len(u.split()) for u in long] == [60, 60, 20]
    assert " ".join(long) == words
    assert [len(u.split()) for u in clauses] == [50, 50]
    assert [len(u.split()) for u in mixed] == [2, 60, 60, 2] and " ".join(mixed) == tail


def test_sentence_units_are_those_of_the_twin(spark):
    """Random texts of all that matters to the rules, in both engines."""
    import duckdb
    import pandas as pd

    from aspectra.plans.q_text import sentences_sql

    rng = random.Random(3)
    bits = ["word", "Wow", "etc", "e.g", "Mr", "no", "x1", "6.1", ".", "...", "!", "?", '."', ".)", ",", " ", "  ", " ", " ", "\n", "\r\n", "- ", "• ", "\u00a0", "\t", "é", "..etc", "A.co", "vs. ", "etc. vs. no. "]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    rows += [" ".join(rng.choice(["a", "b,", "c", "d.", "e"]) for _ in range(rng.randint(50, 300))) if i % 2 else ", ".join(" ".join(["w"] * rng.randint(1, 90)) for _ in range(rng.randint(1, 6))) for i in range(200)]
    frame = pd.DataFrame({"i": range(len(rows)), "text": rows})
    want = duckdb.connect().register("t", frame).sql(f"SELECT {sentences_sql('text')} AS u FROM t ORDER BY i").fetchall()
    got = texts(spark, X.split_sentences, rows)
    assert got == [u for (u,) in want]


def test_units_by_table_functions(spark):
    """The table functions' rules are the engine's, on random texts and other numbers of words."""
    from aspectra.functions import units

    rng = random.Random(8)
    parts = ["Good", "e.g.", "Dr.", "mr.", "no", "x.", "?!", "...", "a", "word,", "two words", "\n", "\r\n", "- ", "•", "3.5", "\u00a0", "\u2003", ")", '."', " ", "  ", "vs.", "..etc.", "é", ", ", "The end."]
    rows = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + ["", " ", ".", "- ", "long " * 130, "some words, " * 70]
    assert texts(spark, X.split_sentences, rows) == [units.units_of(r) for r in rows]
    assert texts(spark, lambda c: X.split_sentences(c, 2, 5), rows) == [units.units_of(r, 2, 5) for r in rows]
    units.register(spark)
    df = spark.createDataFrame([(1, "One two three. Four five six."), (1, "Seven eight nine."), (2, None), (3, "")], "k int, t string")
    got = spark.sql("SELECT k, u.* FROM {df}, LATERAL sentence_units(t, 3, 4) u", df=df).collect()
    assert sorted((r.k, r.position) for r in got) == [(1, 0), (1, 0), (1, 1)]
    numbered = spark.sql("SELECT * FROM units_of_table(TABLE({df}) PARTITION BY k)", df=df).collect()
    assert sorted((r.key, r.position) for r in numbered) == [(1, 0), (1, 1), (1, 2)]
    with pytest.raises(Exception, match="constants"):
        spark.sql("SELECT u.* FROM {df}, LATERAL sentence_units(t, k) u", df=df).collect()


@pytest.mark.parametrize(
    ("title", "brand", "name"),
    [
        ("Samsung Galaxy Note 5 SM-N920V Gold 32GB (Verizon)", "Samsung", "Samsung Galaxy Note 5"),
        ("Samsung Galaxy S8+ 64GB GSM Unlocked", "samsung", "Samsung Galaxy S8 Plus"),
        ("Nokia 3.1 - Android 9.0 Pie - 16 GB - Dual SIM", "Nokia", "Nokia 3.1"),
        ("Galaxy J5 SM-J500H/DS", "Samsung", "Samsung Galaxy J5"),
        ("Motorola Moto G6", "Motorola", "Motorola G6"),
        (None, "LG", "LG"),
    ],
)
def test_canonical_names(spark, title, brand, name):
    df = spark.createDataFrame([(title, brand)], "t string, b string")
    assert df.select(X.canonical_name(F.col("t"), F.col("b")).alias("v")).first().v == name


def test_halves_round_by_the_binary_product(spark):
    """8.1296875 times a million is a little less than a half: SQL rounds it down, the shortest decimal would go up."""
    from aspectra.functions.scores import rounded

    got = spark.createDataFrame([(8.1296875,), (5.7390625,), (9.325,), (None,)], "x double").select(rounded("x", 6).alias("x")).collect()
    assert [r.x for r in got] == [8.129687, 5.739063, 9.325, None]


def test_cleaning_skips_only_patterns_that_cannot_match(spark):
    texts = ["a  b", " x\u00a0\ty ", "see WWW.a.b now", "HTTPS://q.r/s", "me@x.yz", "READ  MORE", "Read More.", "SEE ALL REVIEWS", "&amp;lt;b&gt;", "“q”…", "a<b>c", "x !!!! y", "", None]
    import re

    def brute(t):
        t = t or ""
        for a, b in X.ENTITIES:
            t = t.replace(a, b)
        t = t.translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO)).replace("…", "...").replace("�", "")
        t = re.sub(X.EMAIL, " [EMAIL] ", re.sub(r"(?i)https?://\S+|www\.\S+", " [URL] ", re.sub(X.TAG, " ", t)))
        for p in X.BOILERPLATE:
            t = re.sub(p, " ", t)
        return re.sub(r"\s+", " ", re.sub(r"([!?.,])\1{2,}", r"\1\1", t)).strip(" ")

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.clean_text(F.col("t")).alias("c")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
