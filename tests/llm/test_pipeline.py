from __future__ import annotations

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, sf), f"test-{name}")
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert len(ids) == len(set(ids))
        assert set(ids) <= before and ids
        if name in ("secrets", "packing"):
            assert set(ids) == before
        before, docs = set(ids), out


def odd_documents(spark):
    """Nulls in any column, empty and equal texts, repeated rows and ids, a long text, and more columns."""
    good = "the people of the town were at work on the old bridge and it was a quiet day for all of them there"
    rows = [(i, f"{good} {i} {chr(97 + i % 26) * 5}", "en", "s", 1, None) for i in range(40)]
    rows += [(i, f"le pont de la ville est une vieille place pour les gens qui sont dans la rue {i}", "fr", "s", 1, "x") for i in range(40, 60)]
    rows += [(60, None, "en", None, None, "x"), (61, "", None, "s", 0, None), (62, " \n ", "en", "s", 3, "x"), (63, "12 345 !!", "fr", "s", 9, "x"), (None, f"{good} without an id", "en", "s", 1, "x"), (0, rows[0][1], "en", "s", 1, None), (64, (good + " and so on, ") * 3000, "en", "s", 1, "x"), (65, "a note from the station says that they have not seen her since the spring token=abcdefgh12 end", None, "s", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls string")


def test_every_stage_on_odd_documents(spark, tmp_path):
    """Stage after stage: defined results, and columns kept; languages and scores decide the first."""
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, 1, int(i % 20 == 7)) for i in range(60)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        if name == "packing":
            break
        assert out.columns == docs.columns, name
        docs = out
        texts = [r.text for r in docs.collect()]
        if name == "language":
            assert len(texts) == 64 and not any(t is None or not t.strip() or t[0] == "1" for t in texts)
        if name == "near_duplicates":
            assert len(texts) == len(set(texts))
        if name == "secrets":
            assert sum("[secret]" in t for t in texts) == 1
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert first.count() == 68


def test_the_network_decides_the_language_stage(spark):
    from aspectra.llm import language

    docs = odd_documents(spark)
    french = language.keep_known(docs, ("fr",)).collect()
    assert {r.doc_id for r in french} == set(range(40, 60))
    assert language.keep_known(docs, ("xx",)).count() == 0
    assert language.keep_known(docs, least=1.01).count() == 0


def test_no_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
