from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs_of

from aspectra.llm import components, embeddings, near_duplicates


def roots_of(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def near_corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(55)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 7, 9, 14, 20, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    for _ in range(40):  # a passage that many share
        own = [rng.choice(vocabulary) for _ in range(120)]
        texts.append(" ".join(own[:60] + shared + own[60:]))
    return texts


@pytest.mark.parametrize("words", [4, 5])
@pytest.mark.parametrize("block", [4, 256])
def test_components_are_those_of_all_pairs(spark, monkeypatch, words, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    texts = [*ODD, *near_corpus(), "A b C d E", "a B c D e", "one two", "one  TWO"]
    sets = [shingles(t, words) for t in texts]
    edges = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots_of(len(texts), edges)
    df = docs_of(spark, texts).repartition(3)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(df, words).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].kept for i in range(len(texts))] == [w == i for i, w in enumerate(want)]


@pytest.mark.parametrize("long_list", [6, None])
def test_long_lists_of_unrelated_documents_are_divided(spark, long_list):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join([f"a{rng.randrange(10**6)}" for _ in range(60)] + passage) for _ in range(40)]
    texts += [texts[0] + " more", texts[7].replace("p5 ", "q5 ")]
    sets = [shingles(t, 4) for t in texts]
    edges = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs_of(spark, texts), 4, long_list=long_list).collect()}
    assert [got[i] for i in range(len(texts))] == roots_of(len(texts), edges)


def test_recall_of_long_sets_in_divided_lists(spark):
    """Pairs of long sets close to the threshold, all behind one passage: a division loses none that whole lists have."""
    rng = random.Random(31)
    passage, texts = [f"p{i}" for i in range(60)], []
    for i in range(120):
        own = [f"{i}x{rng.randrange(10**6)}" for _ in range(220)]
        other = list(own)
        for k in range(5 + i % 3):
            other[20 + 30 * k] = f"{i}y{k}"
        texts += [" ".join(passage + own), " ".join(passage + other)]
    sets = [shingles(t, 4) for t in texts]
    linked = [100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1]) for i in range(0, 240, 2)]
    assert sum(linked) > 100
    runs = [{r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs_of(spark, texts), 4, long_list=n).collect()} for n in (6, None)]
    assert runs[0] == runs[1] == {i: i // 2 * 2 if linked[i // 2] else i for i in range(240)}


def test_links_of_small_sets_survive_a_division(spark, monkeypatch):
    """Sets of 5 and 6 values that share one run of three, in a list of unrelated ones with it."""
    run, left, right = [50, 60, 70], [10, 20], [80, 90]
    rows = [(100, [10, 20, *run], None), (101, [10, 20, 40, *run], None), (102, [*run, 80, 90], None), (103, [*run, 75, 80, 90], None)]
    rows += [(i, [1000 + 10 * i, 1001 + 10 * i], None) for i in range(20)]
    sets = [(i, sorted([*run, *own]) if i < 100 else sorted(own)) for i, own, _ in rows]
    classes = spark.createDataFrame([(i, i, len(x), x) for i, x in sets], "cls long, first_id long, n_shingles long, sketch array<long>")
    monkeypatch.setattr(near_duplicates.Search, "sets_of", lambda self, ids: classes.select("cls", F.col("sketch").alias("shingles")).join(ids, "cls", "left_semi"))
    roots = {r.a: r.root for r in near_duplicates.Search(classes, classes, 4, 80, 80, 6).run().collect()}
    edges = [(i, j) for (i, x), (j, y) in itertools.combinations(sets, 2) if 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})]
    assert edges == [(100, 101), (102, 103)]
    assert roots == {101: 100, 103: 102}


def test_similar_sets_share_two_keys(spark):
    """Whole sets at the threshold, with the values apart where they leave the fewest common runs."""
    rows = []
    for union in range(5, 81):
        for apart in range(1, union // 5 + 1):
            parts = np.array_split(np.arange(union - apart), apart + 1)
            line = []  # common values, and one apart between each two parts
            for k, part in enumerate(parts):
                line += [("c", x) for x in part] + ([("d", k)] if k < apart else [])
            for own in range(apart + 1):  # how many of those apart are the first set's
                a = [i for i, (kind, k) in enumerate(line) if kind == "c" or k < own]
                b = [i for i, (kind, k) in enumerate(line) if kind == "c" or k >= own]
                if min(len(a), len(b)) >= 4:
                    rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    keys = [near_duplicates.run_keys(F.col(c), F.size(c)) for c in ("a", "b")]
    assert df.agg(F.min(F.size(F.array_intersect(*keys)))).first()[0] >= 2


def test_ids_that_stand_for_several_texts(spark):
    """Null and repeated ids: classes are verified on their own texts."""
    rng = random.Random(8)
    base = [[f"{k}{rng.randrange(10**6)}" for _ in range(150)] for k in "abc"]
    rows = [(None, " ".join(b)) for b in base] + [(None, " ".join(b[:-1] + ["end"])) for b in base] + [(7, " ".join(base[0])), (7, " ".join(base[1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = near_duplicates.near_duplicates(df, 4).collect()
    assert len(made) == 8
    assert {(r.doc_id, r.component_id) for r in made} == {(None, 7), (None, None), (7, 7)}


def test_one_of_each_stays(spark):
    df = docs_of(spark, ["a b c d e f g h", "a b c d e f g h", "other words altogether here now", None, ""])
    df = df.unionByName(df.where("doc_id = 0")).unionByName(df.where("doc_id = 0").selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "cls"))
    kept = near_duplicates.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0
    assert near_duplicates.drop_near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_stays_whatever_ids_and_names(spark):
    """Null and repeated ids that stand for several texts, and columns named like the operator's own."""
    rng = random.Random(12)
    base = [[f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "abc"]
    near = [" ".join(b[:-1] + ["end"]) for b in base]
    full = [" ".join(b) for b in base]
    rows = [(None, full[0]), (None, near[0]), (None, full[1]), (7, full[2]), (7, near[2]), (8, full[1]), (8, full[1]), (9, None), (9, ""), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, cls int, _kept int, root int, text_key int")
    out = near_duplicates.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == 7
    assert sum(t in (full[0], near[0]) for _, t in got) == sum(t in (full[2], near[2]) for _, t in got) == 1
    assert [i for i, t in got if t == full[1]] == [8]
    assert sorted([(i is None, t is None) for i, t in got if not t]) == [(False, False), (False, True), (True, False), (True, True)]


def test_common_opening_loses_no_link(spark):
    """1,500 pairs of 5 and 6 shingles behind an opening whose shingles are neighbours in hash order."""
    rng = random.Random(6)
    for _ in range(2000):
        opening = [f"o{rng.randrange(10**6)}" for _ in range(6)]
        values = np.sort(near_duplicates.shingle_set(" ".join(opening).encode(), 4))
        if float(values[-1]) - float(values[0]) < 2.0**64 / 1000:
            break
    texts = []
    for i in range(1500):
        own = [*opening, f"x{i}", f"y{i}"]
        texts += [" ".join(own), " ".join([*own, f"z{i}"])]
    sets = [shingles(t, 4) for t in texts[:2]]
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs_of(spark, texts), 4).collect()}
    assert [got[i] for i in range(3000)] == [i // 2 * 2 for i in range(3000)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = dict(components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect())
    want = roots_of(400, edges)
    assert got == {i: w for i, w in enumerate(want) if w != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("many", [20, 1024])
def test_vectors_against_all_pairs(spark, monkeypatch, many):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "MANY", many)
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=16) for _ in range(300)]
    for _ in range(60):
        rows.append(rows[5] + rng.normal(size=16) * 0.05)
    rows += [rows[0]] * 3
    v = np.array(rows, np.float32).astype(np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, None]]
    data = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(1000 + i, x, 0) for i, x in enumerate(odd)] + [(2000, [1.0, 2.0], 0), (2001, [2.0, 4.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(len(v))])
    exact = link.sum(1)
    assert (found <= exact).all() and found.sum() >= 0.95 * exact.sum()
    want = roots_of(len(v), list(zip(*np.nonzero(link))))
    assert np.mean([got[i].component_id == want[i] for i in range(len(v))]) > 0.98
    for i in range(1000, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[2001].n_links, got[2001].component_id, got[2001].kept) == (1, 2000, False)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    exact = (v @ v.T >= 0.9).sum() - len(v)
    found = sum(r.n_links for r in embeddings.near_vectors(df).collect())
    assert found <= exact and found >= 0.97 * exact


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(cosine, n, rng):
    a, b = unit(rng.normal(size=(n, 64))), rng.normal(size=(n, 64))
    return a, cosine * a + (1 - cosine**2) ** 0.5 * unit(b - (a * b).sum(1, keepdims=True) * a)


@pytest.mark.parametrize("pivots", [100, 257, 640, 1024, 2048, 4096, 8192])
def test_pairs_at_the_threshold_meet_at_any_pivot_count(pivots):
    rng = np.random.default_rng(pivots)
    reference = unit(rng.normal(size=(pivots, 64)))
    x, y = (embeddings.nearest(v, reference) for v in pairs_at(0.9, 2000, rng))
    m = embeddings.posted_in(pivots)
    meet = (x[:, :m, None] == y[:, None, :m]).any((1, 2))
    assert (meet & ((x[:, :, None] == y[:, None, :]).any(2).sum(1) >= embeddings.SHARED)).mean() >= 0.98


def test_pivots_are_in_order_of_nearness():
    rng = np.random.default_rng(2)
    own, reference = unit(rng.normal(size=(50, 8))), unit(rng.normal(size=(40, 8)))
    want = np.argsort(-(own @ reference.T), axis=1, kind="stable")[:, : embeddings.DESCRIBED]
    assert (embeddings.nearest(own, reference) == want).all()
    same = np.ones((3, 4)) / 2
    assert (embeddings.nearest(same[:1], same) == [[0, 1, 2]]).all()


def test_shared_pivots_are_counted():
    pivots = np.random.default_rng(5).permuted(np.tile(np.arange(40, dtype=np.int32), (30, 1)), axis=1)[:, : embeddings.DESCRIBED]
    left, right = np.arange(12), np.arange(12, 30)
    got = embeddings.candidates(pivots, left, right)
    assert (got == [[len({*pivots[a]} & {*pivots[b]}) >= embeddings.SHARED for b in right] for a in left]).all()


def test_links_at_the_threshold_with_many_pivots(spark):
    rng = np.random.default_rng(11)
    a, b = pairs_at(0.901, 1000, rng)
    rows = np.concatenate([a, b, unit(rng.normal(size=(8000, 64)))])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, pivot_count=2048).collect()}
    assert sum(got.values()) <= 2000 + 2
    assert sum(got[i] for i in range(2000)) >= 0.975 * 2000
