from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Every round over every part, with Python's integers."""
    kept = []
    for vec_id, v, label, *_ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    part = lambda x, p: x[p * width : (p + 1) * width]
    books = [[part(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda x: [min(range(len(books[p])), key=lambda k: (far(part(x, p), books[p][k]), k)) for p in range(parts)]
    for _ in range(rounds):
        said = [near(x) for _, x, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [part(x, p) for (_, x, _), s in zip(kept, said) if s[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    said = [near(x) for _, x, _ in kept]
    errors = [sum(far(part(x, p), books[p][s[p]]) for p in range(parts)) for (_, x, _), s in zip(kept, said)]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, bytes(s).hex(), e, by_label[label], digest) for (i, _, label), s, e in zip(kept, said, errors)), key=repr)


def random_rows(n, seed, dims=32, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(dims)], rng.choice([None, 0, 1, 7]), "c", 1) for i in range(n)]
    bad = [(1000, None, 1), (1001, [math.nan] * dims, 1), (1002, [math.inf, *[0.0] * (dims - 1)], 2), (-5, [None, *[0.0] * (dims - 1)], 2), (1003, [], 1)]
    odd = [(None, [0.0] * dims, None), (3, [0.5] * dims, 1), (3, [0.25] * dims, 1), (4, rows[4][1] if n > 4 else [1.0] * dims, 0)]
    return rows + [(*r, "c", 1) for r in bad + odd]


@pytest.mark.parametrize(("n", "seed", "scale"), [(150, 1, 1.0), (20, 2, 1.0), (90, 3, 30000.0)])
def test_by_the_contract(spark, n, seed, scale):
    rows = [r for r in random_rows(n, seed, scale=scale) if r[0] != 1003]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in codes.encode(df).collect()), key=repr)
    assert got == brute(rows)


def test_rounds_shuffle_only_what_changed(spark):
    """A round's contributions undo the one before where an entry changed, and are none where nothing did."""
    df = spark.createDataFrame(random_rows(120, 5), SCHEMA)
    state, books = codes.train(df, rounds=1)
    n = state.count()
    assert books.counts.sum() == 16 * n
    changed = codes._changes(state, books)
    rows = changed.collect()
    assert sum(r.n for r in rows) == 0 and rows
    same = codes._assigned(state, books)
    assert codes._changes(same, books).count() == 0
    moved = state.select("was", "code").collect()
    moved = sum(a != b for r in moved for a, b in zip(r.was, r.code))
    assert sum(abs(r.n) for r in rows) <= 2 * moved < 2 * 16 * n


def test_other_lengths_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [float(i + j) for j in range(5)], 1, "c", 1) for i in range(9)] + [(9, [1.0] * 7, 1, "c", 1), (10, [1.0], 1, "c", 1)], SCHEMA)
    got = codes.encode(df, parts=2, entries=4, rounds=3).collect()
    assert sorted(r.vec_id for r in got) == list(range(9))
    assert all(len(r.code) == 4 for r in got)
    empty = codes.encode(df.limit(0))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert codes.encode(df.where("vec_id = 3").withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    with pytest.raises(ValueError):
        codes.train(df, entries=300)


def test_codes_approximate(spark):
    rows = [r for r in random_rows(100, 6) if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    state, books = codes.train(df)
    named = state.select("vec_id", F.lower(F.hex("code")).alias("code"), "x", "error")
    near = codes.decode(named, books).join(named, "vec_id").where("vec_id <> 3 and vec_id <> 4").collect()
    for r in near:
        assert sum((a - b * 256) ** 2 for a, b in zip(r.x, r.approximated)) == r.error


def test_labels_that_are_not_sent(spark, monkeypatch):
    rows = random_rows(60, 7)
    df = spark.createDataFrame([r for r in rows if r[0] != 1003], SCHEMA)
    sent = sorted((tuple(r) for r in codes.encode(df).collect()), key=repr)
    monkeypatch.setattr(codes, "SENT", 1)
    assert sorted((tuple(r) for r in codes.encode(df).collect()), key=repr) == sent
