from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aspectra.constants import AXES
from aspectra.operators import recommend


@pytest.mark.parametrize("limit", [1, 5, 400])
def test_cells_give_the_ranks_of_all_profiles(spark, limit):
    """Ranks, ties among them, are those of every profile; cells that can't matter are not read."""
    rng = random.Random(limit)
    rows = [(f"m{i}", *(rng.choice([1.0, 10.0, float(rng.randrange(1, 11)), rng.uniform(1, 10)]) for _ in AXES)) for i in range(300)]
    rows += [(f"t{i}", 5.0, 5.0, 5.0, 5.0, 5.0) for i in range(12)]
    profiles = spark.createDataFrame(rows, "model_key string, " + ", ".join(f"{a} double" for a in AXES)).repartition(3)
    needs = [(q, *(float(rng.randrange(1, 11)) for _ in AXES)) for q in range(6)] + [(6, 1.0, 1.0, 1.0, 1.0, 1.0), (7, 5.0, 5.0, 5.0, 5.0, 5.0), (8, 10.0, 10.0, 10.0, 10.0, 10.0)]
    asked = spark.createDataFrame(needs, "query_id int, " + ", ".join(f"need_{a} double" for a in AXES))
    index = recommend.ProfileIndex.of(profiles)
    got, seen = index.rank_many(asked, limit)
    keys = lambda df: sorted((r.query_id, r.rank, r.model_key, r.worst_axis) for r in df.select("query_id", "rank", "model_key", "worst_axis").collect())
    assert keys(got) == keys(recommend.rank_many(profiles, asked, limit))
    assert seen["read"] <= seen["cells"] == index.bounds.count()
    one, seen = index.rank_many(asked.where("query_id = 7"), limit)
    assert one.count() == min(limit, 312)
    if limit == 1:
        assert seen["read"] < seen["cells"]


def test_no_profiles(spark):
    profiles = spark.createDataFrame([], "model_key string, " + ", ".join(f"{a} double" for a in AXES))
    asked = spark.createDataFrame([(1, 2.0, 2.0, 2.0, 2.0, 2.0)], "query_id int, " + ", ".join(f"need_{a} double" for a in AXES))
    got, seen = recommend.ProfileIndex.of(profiles).rank_many(asked, 3)
    assert got.select(F.col("rank")).count() == 0 and seen == {"cells": 0, "read": 0}
