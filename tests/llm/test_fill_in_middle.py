from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs_of

from aspectra.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SOME = ["", " ", "\n\n", "a", " a", "a ", "é", "😀 日本\t語  ", "a\x0bb\x1cc", "<P>", "x <S> y", "<M", "a<P", "< P>", "\x85\xa0 x", "word " * 500]


def brute(doc_id, text, unit="token"):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    parts = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), out


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b", " ", "\n", "é", "日", "😀", "\x1c", "<", ">", "P", "S", "M", " the"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("unit", ["token", "char"])
def test_by_the_contract(spark, unit):
    texts = [*SOME, *ODD, *random_texts(300)]
    df = docs_of(spark, texts).unionByName(docs_of(spark, ["two words"]).withColumn("doc_id", F.lit(None).cast("long"))).repartition(3)
    rows = fim.transform(df, unit).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) + 1
    forms = set()
    for r in rows:
        text = "two words" if r.doc_id is None else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, text, unit), repr(text)
        assert r.again == (text or "")
        forms.add(r.form)
    assert forms == {"plain", "spm", "psm"}


def test_every_cut_of_every_run():
    """The place after each number of units is the length of so many parts, in a slice of a longer array too."""
    texts = [t for t in [*SOME, *random_texts(40, 2)]]
    whole = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    for unit, cut in (("token", TOKEN.findall), ("char", list)):
        runs = fim.runs_of(whole, unit)
        parts = [cut(t) for t in texts]
        assert runs.totals.tolist() == [len(p) for p in parts]
        for k in range(70):
            at = np.minimum(runs.totals, k)
            want = [len("".join(p[:k]).encode()) for p in parts]
            assert (runs.place(at) - runs.bounds[:-1]).tolist() == want
    assert fim.runs_of(pa.array([], pa.string())).totals.tolist() == []


def test_rates_and_unknown_units(spark):
    df = docs_of(spark, ["some words of text"] * 40)
    assert {r.form for r in fim.transform(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(df, rate=100, suffix_first=100).collect()} == {"spm"}
    assert fim.transform(df, seed="7").select("form").collect() != fim.transform(df).select("form").collect()
    assert fim.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(df, "word")


def test_a_very_long_text(spark):
    long = docs_of(spark, ["x"]).withColumn("text", F.repeat(F.lit("one é  two\n"), 1_000_000))
    r = fim.transform(long, rate=100).select("n", "form", (F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256) == F.sha2(F.lit("one é  two\n" * 1).cast("binary"), 256)).alias("no"), F.length(fim.restored(F.col("output"), F.col("form"))).alias("chars")).first()
    assert (r.n, r.no, r.chars) == (3_000_001, False, 11_000_000)
