from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import docs_of

from aspectra.llm import language, toxicity


def brute_segments(scores):
    """Maximal segments by their definition, found by recursion on the best one."""
    if not len(scores):
        return []
    sums = np.concatenate(([0], np.cumsum(scores)))
    best = max(((sums[j] - sums[i], -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), key=lambda x: (x[0], x[1]))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [*brute_segments(scores[:i]), (i, j), *((a + j, b + j) for a, b in brute_segments(scores[j:]))]


@pytest.mark.parametrize("seed", range(20))
def test_segments_are_all_maximal_ones(seed):
    scores = np.random.default_rng(seed).normal(-0.3, 1.5, 25)
    got = toxicity.segments(scores)
    assert [(a, b) for a, b, _ in got] == brute_segments(scores)
    for a, b, s in got:
        assert s == pytest.approx(scores[a:b].sum())


WORDS = [f"{a}{b}" for a in "ba ke li mo nu ra se ti".split() for b in "dor fin gal hem jus kop lar mit".split()]


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilrat", "scumbo", "trasho"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_toxic_texts_are_told_apart(spark):
    texts, labels = corpus()
    odd = [None, "", "12 34 !!", "vilrat " * 3000]
    df = docs_of(spark, texts + odd)
    rows = [(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (5, 1, None), (7, 1, labels[7]), (99999, 0, 1)]
    truth = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(df, truth).collect()}
    held = [i for i in range(len(labels)) if got[i].held_out]
    assert 60 < len(held) < 200
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    n = len(texts)
    assert got[n].score == got[n + 1].score == got[n + 2].score < 0.5
    assert got[n + 3].predicted == 1 and got[n + 3].n_passages >= 1
    some = next(i for i in held if labels[i])
    passage = texts[some][got[some].first_char : got[some].end_char]
    assert any(w in passage for w in ("vilrat", "scumbo", "trasho"))
    kept = {r.doc_id for r in toxicity.drop_toxic(df, truth).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    assert toxicity.detect(df.limit(0), truth).count() == 0


def test_repeated_rows_are_learnt_from_once(spark):
    texts, labels = corpus(200)
    truth = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, texts)
    many = df.unionByName(df.where("doc_id in (1, 4)").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("n"))
    from aspectra.llm.common import crc_fold

    one, other = (toxicity.fit(x, truth, crc_fold("doc_id", 5) != 0) for x in (df, many))
    assert one.weights == pytest.approx(other.weights) and (one.scale, one.shift) == pytest.approx((other.scale, other.shift))


def test_places_are_those_of_the_text(spark):
    assert toxicity.without_case("İSTANBUL ΣΑΣ ẞ") == "İstanbul σασ ß" and len(toxicity.without_case("İİ")) == 2
    texts, labels = corpus()
    truth = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    text = "İ" * 50 + " " + " ".join(WORDS[:20]) + " VILRAT scumbo Trasho " + " ".join(WORDS[20:40])
    got = {r.doc_id: r for r in toxicity.detect(docs_of(spark, [*texts, text]), truth).collect()}[len(texts)]
    assert text[got.first_char : got.end_char] == "VILRAT scumbo Trasho"


def test_repeats_elsewhere_take_nothing_from_a_passage(spark):
    texts, labels = corpus()
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    dense = "vilrat scumbo trasho"
    apart = " ".join(f"{filler(200)} {w}" for w in dense.split())
    late = f"{apart} {filler(300)} {dense} {filler(100)}"
    twice = f"{filler(60)} {dense} {filler(60)} {dense} {filler(60)}"
    truth = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs_of(spark, [*texts, late, twice]), truth).collect()}
    n = len(texts)
    cut = lambda text, r: [text[p.first_char : p.end_char] for p in r.passages]
    assert dense in cut(late, got[n]) and late[got[n].first_char : got[n].end_char] == dense and got[n].predicted == 1
    assert cut(twice, got[n + 1]) == [dense, dense] and got[n + 1].n_passages == 2


@pytest.mark.parametrize("seed", range(10))
def test_damped_segments_are_those_of_the_whole_text(seed):
    """Against brute force: the same places, and the best sum in each with repeats at zero."""
    rng = np.random.default_rng(seed)
    hashes = rng.integers(0, 6, 40).astype(np.uint64)
    scores = rng.normal(0.2, 1.5, 6)[hashes.astype(int)]
    got, n = toxicity.damped(scores, hashes)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in toxicity.segments(scores)]
    gone = 0
    for a, b, s in got:
        seen, own = set(), []
        for x, h in zip(scores[a:b], hashes[a:b].tolist()):
            gone += x > 0 and h in seen
            own.append(0.0 if x > 0 and h in seen else x)
            seen.add(h)
        assert s == pytest.approx(max(sum(own[i:j]) for i in range(b - a) for j in range(i + 1, b - a + 1)))
    assert n == len(scores) - gone


def test_one_class_alone(spark):
    truth = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.detect(docs_of(spark, ["a b", "c", None]), truth).collect()} == {0.0}


def languages(n=400, seed=4):
    rng = random.Random(seed)
    stems = {"xx": "schein ung keit der".split(), "yy": "ción que ado los".split(), "zz": "eau ment très la".split()}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(stems))
        out.append((lang, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80)))))
    return out


def test_languages_are_told_apart(spark):
    rows = languages()
    odd = [None, "", "123 !?", "sch" * 200_000]
    df = docs_of(spark, [t for _, t in rows] + odd)
    lang = F.element_at(F.create_map(*(F.lit(x) for i, (name, _) in enumerate(rows) for x in (i, name))), F.col("doc_id").cast("int"))
    df = df.withColumn("lang", lang)
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [i for i in range(len(rows)) if got[i].held_out]
    assert np.mean([got[i].lang_pred == rows[i][0] for i in held]) > 0.95
    n = len(rows)
    assert [got[n + k].lang_pred for k in range(3)] == ["und"] * 3
    assert got[n + 3].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.keep_known(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.lang_pred != "und"}
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_the_sample_is_bounded_whatever_repeats(spark):
    """One row 50,000 times, a language with most rows, and more labels than are learnt."""
    base = spark.range(3000).selectExpr("id as doc_id", "concat('text number ', id) as text", "case when id % 10 < 8 then 'aa' when id % 10 = 8 then 'bb' else concat('l', id) end as lang")
    df = base.unionByName(spark.range(50_000).selectExpr("cast(7 as long) as doc_id", "'repeated text' as text", "'aa' as lang"))
    rows = language.sampled_ids(df, F.lit(True), 100, 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r.doc_id)
    assert len(by) == 5 and len(by["aa"]) == len(by["bb"]) == 100
    assert all(len(set(x)) == len(x) for x in by.values())
    net = language.train(df, F.lit(True), 100, 2, 5)
    assert len(net.labels) == 5


def test_tables_give_the_convolution():
    net = language.ByteNetwork(["a", "b"])
    windows, counts = language.windows_of([b"some text \xc3\xa9", b""])
    assert counts.tolist() == [1, 1]
    vectors = net.params["vectors"][windows]
    pooled = [sum(vectors[:, k : language.WINDOW - w + 1 + k] @ net.params[f"filter{w}"][k] for k in range(w)).max(1) for w in language.WIDTHS]
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.params["out"] + net.params["bias"]
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(net.log_probs(windows), logits, atol=1e-4)
