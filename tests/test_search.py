from __future__ import annotations

import random

from pyspark.sql import functions as F

from aspectra.operators.search import TrigramIndex


def test_found_rows_are_those_of_a_scan(spark):
    """Random queries of any length, wildcards and odd characters among them."""
    rng = random.Random(6)
    letters = ["a", "b", "c", "A", " ", "%", "_", "é", "É", "😀", "ß", "."]
    data = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))) for i in range(400)] + [(400, None), (401, ""), (402, "a"), (402, "ab"), (403, "aaaaaaaa")]
    df = spark.createDataFrame(data, "k int, name string").repartition(4)
    index = TrigramIndex.of(df, "k", "name")
    words = ["", "a", "ab", "aab", "a%", "_", "É", "é.", "😀a", "zzz", "b a", "aaaaaaaaa", "ß"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    for q in words:
        got = sorted((r.k, r.name) for r in index.containing(q).select("k", F.coalesce("name", F.lit("-")).alias("name")).collect())
        want = df if not q else df.where(F.contains(F.lower("name"), F.lit(q.lower())))
        assert got == sorted((r.k, r.name) for r in want.select("k", F.coalesce("name", F.lit("-")).alias("name")).collect()), repr(q)


def test_pages_and_totals(spark):
    df = spark.createDataFrame([(i, f"Phone {i % 7} x", i % 2) for i in range(50)], "k int, name string, simulated int")
    index = TrigramIndex.of(df, "k", "name")
    page = index.search(" phone 3 ", [F.desc("k")], limit=2, offset=1, fits=F.col("simulated") == 0).collect()
    want = [i for i in range(49, -1, -1) if i % 7 == 3 and i % 2 == 0]
    assert [(r.k, r.total) for r in page] == [(k, len(want)) for k in want[1:3]]
    assert index.search("nothing", [F.desc("k")]).count() == 0
    none = TrigramIndex.of(df.limit(0), "k", "name")
    assert none.containing("a").count() == none.containing("").count() == 0


def test_the_index_is_read_by_gram(spark):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(30)], "k int, name string")
    plan = TrigramIndex.of(df, "k", "name").containing("me 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
