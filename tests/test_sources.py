from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aspectra.sources import readers, schemas, sinks
from aspectra.streaming.scoring import score_stream, windowed_counts


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_quoted_breaks(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'asin,name\na,"x\ny ""q"""\nb,z\n')
    rows = readers.read_csv(spark, path, "asin string, name string").select("asin", "name").collect()
    assert [tuple(r) for r in rows] == [("a", 'x\ny "q"'), ("b", "z")]
    assert readers.count_rows(spark, path) == 2


@pytest.mark.parametrize("size", ["16", "57", "100000"])
def test_records_are_counted_in_byte_ranges(spark, tmp_path, size):
    """Random quoted files, cut anywhere, against a parser that reads them whole."""
    import csv
    import io
    import random

    rng = random.Random(11)
    names, total = [], 0
    for k in range(6):
        held = io.StringIO()
        rows = csv.writer(held, quoting=csv.QUOTE_ALL if k % 2 else csv.QUOTE_MINIMAL, lineterminator=rng.choice(["\n", "\r\n"]))
        rows.writerow(["a", "b"])
        n = rng.randrange(0, 30)
        for _ in range(n):
            rows.writerow(["".join(rng.choice(['"', "\n", ",", "x", "é", " ", "\n\n", '""']) for _ in range(rng.randrange(1, 12))) + "y" for _ in range(2)])
        text = held.getvalue() + ("\n\n" if k == 3 else "")
        if k == 4:
            text = text.rstrip("\r\n")
        (tmp_path / f"f{k}.csv").write_text(text, encoding="utf-8", newline="")
        names.append(f"{tmp_path}/f{k}.csv")
        total += n
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert readers.count_rows(spark, names) == total
        (tmp_path / "open.csv").write_text('a,b\n1,"2\n3', encoding="utf-8")
        (tmp_path / "none.csv").write_text("", encoding="utf-8")
        assert readers.count_rows(spark, f"{tmp_path}/open.csv") == 1
        assert readers.count_rows(spark, f"{tmp_path}/none.csv") == 0
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_a_missing_split_is_an_error(spark, tmp_path):
    write(tmp_path / "asc_train.csv", "text\na\n")
    with pytest.raises(FileNotFoundError):
        readers.read_splits(spark, str(tmp_path), "asc", ("train", "dev"), "text string")


def test_json_lists_objects_and_rubbish(spark, tmp_path):
    write(tmp_path / "a.json", '[{"m": 1}, {"m": 2}]')
    write(tmp_path / "b.json", '{"m": 3}')
    write(tmp_path / "c.json", "{oops")
    assert sorted(r.m for r in readers.read_reports(spark, f"{tmp_path}/*.json", "m int").where("m is not null").collect()) == [1, 2, 3]


def test_optional_sidecar(spark, tmp_path):
    assert readers.read_sidecar(spark, f"{tmp_path}/none.json", "m int").count() == 0
    with pytest.warns(UserWarning):
        assert readers.read_sidecar(spark, write(tmp_path / "bad.json", "{oops"), "m int").count() == 0


def test_uploads(spark, tmp_path):
    a = write(tmp_path / "a.txt", "first line\n\nsecond\n")
    b = write(tmp_path / "b.csv", 'id,Review\n1,"good, really"\n2,bad\n')
    assert [r.text for r in readers.read_upload(spark, a).collect()] == ["first line", "second"]
    assert [r.text for r in readers.read_upload(spark, b).collect()] == ["good, really", "bad"]


def test_taxonomy_targets_are_checked(spark):
    assert readers.load_taxonomy(spark, {"phone": {"Screen": "display"}}).count() == 1
    with pytest.raises(ValueError):
        readers.load_taxonomy(spark, {"phone": {"Screen": "nonsense"}})


def test_annotated_lines_are_numbered(spark, tmp_path):
    path = write(tmp_path / "l.txt", "a####[]\nb####[]\nc")
    rows = readers.read_annotated(spark, path, "phone", "dev").orderBy("line_number").collect()
    assert [(r.value, r.line_number) for r in rows] == [("a####[]", 1), ("b####[]", 2), ("c", 3)]


def test_lines_are_numbered_in_each_file(spark, tmp_path):
    """Two files give two sequences from 1, wherever they are cut."""
    names = [write(tmp_path / f"{k}.txt", "".join(f"{k}-{i}####[]\n" for i in range(n))) for k, n in (("a", 90), ("b", 1), ("c", 40))]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "101")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_annotated(spark, names, "phone", "dev").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(rows) == 131 and len({r.file for r in rows}) == 3
    assert all(r.value.split("####")[0].split("-")[1] == str(r.line_number - 1) for r in rows)


def test_scoring_resumes_by_key(spark, tmp_path):
    work = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "model_key string, x int")
    score = lambda df: df.where("x <> 3").withColumn("score", F.col("x") * 2)
    path = str(tmp_path / "facts")
    assert sinks.append_pending(work.where("x = 1"), path, "model_key", score) == 1
    assert sinks.append_pending(work, path, "model_key", score) == 2
    assert sinks.append_pending(work, path, "model_key", score) == 0  # a key without rows is complete
    assert spark.read.parquet(f"{path}/rows").count() == 2
    assert sinks.append_pending(work, path, "model_key", score, restart=True) == 3


def test_row_store(spark, tmp_path):
    store = sinks.ReviewStore(spark, str(tmp_path / "store"))
    assert store.count() == 0
    new = spark.createDataFrame([("k", "t1", 5, "{}"), ("k", "t2", 4, "{}")], "model_key string, text string, rating int, analysis string")
    store.add(new)
    store.add(new.where("text = 't1'"))
    assert [r.id for r in store.latest("k", 2).collect()] == [3, 2]
    assert store.count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "dev"), ("b", "y", "test")], "id string, text string, split string")
    sinks.write_splits(df, str(tmp_path / "s"), "parquet")
    assert spark.read.parquet(str(tmp_path / "s/split=dev")).count() == 1
    sinks.write_columns(df, ["id"], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id"]
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_violations_are_rows(spark):
    df = spark.createDataFrame([(11.0, None), (5.0, "k")], "score double, model_key string")
    got = {r.rule: r.n for r in schemas.violations(df, {"range": "score BETWEEN 1 AND 10", "key": "model_key IS NOT NULL"}).collect()}
    assert got == {"range": 1, "key": 1}
    with pytest.raises(ValueError):
        schemas.parameters_in_range(limit=(99, 1, 50))


def test_stream_scores_each_file_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    run = lambda: score_stream(spark, source, "k string, x int", sink, check, lambda df: df).awaitTermination()
    spark.createDataFrame([("a", 1)], "k string, x int").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert spark.read.parquet(sink).count() == 1
    spark.createDataFrame([("b", 2)], "k string, x int").coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(sink).count() == 2


def test_event_windows(spark, sf):
    out = windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_models_are_chosen(spark, tmp_path):
    assert readers.resolve_stage("auto", {"a": True, "b": True}, {"a": 0.1, "b": 0.9}) == "b"
    with pytest.raises(ValueError):
        readers.resolve_stage("b", {"b": False}, {})
    with pytest.raises(FileNotFoundError):
        readers.load_model(spark, str(tmp_path))


def test_taxonomy_file(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("version: 3\naspects: {battery: {label: Battery}}\nphone_map:\n  Battery/Longevity: battery\n  Screen: display\nattribute_overrides: {PRICE: price}\n")
    got = {(r.kind, r.source, r.aspect) for r in readers.read_taxonomy(spark, f"{tmp_path}/t.yaml").collect()}
    assert got == {("phone_map", "Battery/Longevity", "battery"), ("phone_map", "Screen", "display"), ("attribute_overrides", "PRICE", "price")}
    (tmp_path / "u.yaml").write_text("phone_map: {Screen: nonsense}")
    with pytest.raises(ValueError):
        readers.read_taxonomy(spark, f"{tmp_path}/u.yaml")


def test_promotion_and_the_way_back(spark, tmp_path):
    import json

    from aspectra.sources import models

    def model(name, complete=True):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "metadata.json").write_text(json.dumps({"name": name}))
        if complete:
            (folder / "model").mkdir()
            (folder / "model" / "part").write_text(name)
        return str(folder)

    one, two, half = model("one"), model("two"), model("half", False)
    target = f"{tmp_path}/served"
    with pytest.raises(FileNotFoundError):
        models.promote(spark, half, target)
    with pytest.raises(FileNotFoundError):
        models.rollback(spark, target)
    assert models.promote(spark, one, target, dry_run=True)["name"] == "one" and not (tmp_path / "served").exists()
    models.promote(spark, one, target)
    record = models.promote(spark, two, target, "better on dev")
    served = lambda: json.loads((tmp_path / "served" / "metadata.json").read_text())
    assert served() == record and record["promoted"]["reason"] == "better on dev"
    assert (tmp_path / "served" / "model" / "part").read_text() == "two" and (tmp_path / "served.previous" / "model" / "part").read_text() == "one"
    models.rollback(spark, target)
    assert served()["name"] == "one" and not (tmp_path / "served.previous").exists()


def test_fetching(tmp_path):
    import zipfile

    from aspectra.sources import fetch

    source = tmp_path / "source.zip"
    with zipfile.ZipFile(source, "w") as archive:
        archive.writestr("deep/a.csv", 'x,y\n1,"two\nlines"\n2,z\n\n')
        archive.writestr("b.txt", "b")
    with pytest.warns(UserWarning, match="2 rows, not 3"):
        record = fetch.fetch(source.as_uri(), tmp_path / "out", ("deep/a.csv",), {"a.csv": 3})
    assert record["files"]["a.csv"]["rows"] == 2 and (tmp_path / "out" / "provenance.json").exists() and not (tmp_path / "out" / "b.txt").exists()
    (tmp_path / "out" / "a.csv").write_text("x\n1\n")
    assert fetch.fetch(source.as_uri(), tmp_path / "out", ("deep/a.csv",))["files"]["a.csv"]["rows"] == 1
    assert fetch.fetch(source.as_uri(), tmp_path / "out", ("deep/a.csv",), force=True)["files"]["a.csv"]["rows"] == 2
    assert set(fetch.fetch(source.as_uri(), tmp_path / "all")["files"]) == {"a.csv", "b.txt"}
