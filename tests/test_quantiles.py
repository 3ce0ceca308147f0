from __future__ import annotations

import math
import random

import numpy as np
import pytest

from aspectra.operators import quantiles


def samples():
    rng = random.Random(3)
    yield "few", [3.0, 1.0, 2.0]
    yield "one", [5.0]
    yield "equal", [2.0] * 50
    yield "ties", [float(rng.randrange(5)) for _ in range(400)]
    yield "wide", [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(900)]
    yield "edge", [1.0, math.nextafter(1.0, 2.0), math.nextafter(1.0, 0.0)] * 40 + [1e308, -1e308]
    yield "skew", [1.0] * 500 + [rng.random() for _ in range(300)] + [1e9]


@pytest.mark.parametrize("few", [2048, 3])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    shares = [0.0, 0.05, 0.1, 0.5, 0.9, 0.99, 1.0]
    for name, values in samples():
        df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double").repartition(3)
        got = quantiles.quantiles(df, "v", shares)
        ordered = np.sort(values)
        for q, g in zip(shares, got):
            p = q * (len(ordered) - 1)
            a, b = ordered[math.floor(p)], ordered[math.ceil(p)]
            assert g == pytest.approx(a + (p - math.floor(p)) * (b - a), rel=1e-12), (name, q)
    assert quantiles.quantiles(df.limit(0), "v", [0.5]) == [None]


def test_quantiles_of_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, 1.0, 2.0, rng.random()])) for _ in range(500)] + [("d", 4.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: (r.p, r.m) for r in quantiles.grouped_quantiles(df, "g", "v", [0.1, 0.5], ["p", "m"]).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        own = [v for k, v in rows if k == g and v is not None]
        want[g] = tuple(np.quantile(own, [0.1, 0.5]))
    assert set(got) == set(want)
    assert all(got[g] == pytest.approx(want[g]) for g in want)
