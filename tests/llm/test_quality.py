from __future__ import annotations

import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs_of

from aspectra.llm import quality, quality_sql
from aspectra.llm.queries import op13_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The contract, word by word."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 8))
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))
    return (*counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["a", "bb", "the", "the,", "é😀", "<|>", "#", "12", "WORD", " x", "und", "que", "\x85"]
    for _ in range(n):
        some = rng.sample(words, rng.randrange(1, len(words)))
        text = rng.choice(["", " ", "\n"])
        for _ in range(rng.randrange(0, 90)):
            text += rng.choice(some) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\n\n", " "])
        yield text + text if rng.random() < 0.3 else text
    line = " ".join(f"w{i}" for i in range(9))
    yield from ("\n".join([line] * 3), f"{line} x {line}", " ".join(["same"] * 8), " ".join(["same"] * 9), " ".join(["same"] * 40), " ".join(f"w{i}" for i in range(7)))


def test_counts_by_the_contract(spark):
    texts = [*ODD, *random_texts(150)]
    df = docs_of(spark, texts).unionByName(docs_of(spark, ["x y"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r.doc_id: r for r in quality.measured(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)
        assert not (r.base_failed and r.kept)
    assert quality.measured(df.limit(0)).count() == 0
    assert quality.keep(df).columns == df.columns


def test_twin_on_random_texts(spark, tmp_path):
    df = docs_of(spark, [*ODD, *random_texts(120, 8)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.execute(f"SELECT * FROM ({quality_sql.twin()}) ORDER BY doc_id")
    names = [c[0] for c in theirs.description]
    assert [tuple(r[n] for n in names) for r in op13_quality(spark, str(tmp_path)).orderBy("doc_id").collect()] == theirs.fetchall()


GOOD = "It was a quiet day in the town and the people who live there were at work on the old bridge, which had been closed for a year. "


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        (GOOD * 1, None), (GOOD + "She said that they had not seen it.", None), (GOOD.upper(), "capitals"), ("lorem ipsum dolor sit amet " + " ".join(f"w{i}x" for i in range(40)), "stop_words"),
        (" ".join(f"the{c} {c}" for c in "abcdefghijklm") + " ||| ### $$$", "symbols"), (GOOD + " 1 2 3 4 5 6 7 8 9 10 11 12", "letter_words"), ("\n".join(f"- {w} the" for w in GOOD.split()), "bullet_lines"),
        ("\n".join(f"{w} of the..." for w in GOOD.split()), "ellipsis_lines"), ("\n".join(["of the day"] * 2 + ["in it"] * 2 + ["by us"] * 2 + ["to be at the work that was the old one", "another village nearby is certainly smaller", "whoever lives there, and since when"]), None),
        ("\n".join(["of the day"] * 3 + ["in it"] * 3 + ["by us and them"] * 2 + ["to be at the work that was the old one"]), "duplicate_lines"), (" ".join(f"to{i}" * 6 for i in range(25)) + " the" * 2, "word_length"),
    ],
)
def test_each_rule(spark, text, rule):
    r = quality.measured(docs_of(spark, [text])).first()
    assert not r.base_failed
    assert r.kept == (rule is None) and (rule is None or rule in r.failed_rules)


def test_other_tables_of_thresholds(spark):
    df = docs_of(spark, [GOOD, GOOD.upper()])
    assert quality.keep(df, ()).count() == 2
    own = (quality.Rule("short", "word_chars", "n_words", most=100),)
    assert [r.failed_rules for r in quality.measured(df, own).collect()] == [["short"]] * 2
    assert [tuple(r) for r in quality.report(df).collect()] == [("capitals", 1)]


def test_plan_is_one_projection(spark, sf):
    plan = op13_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)


def test_a_long_text_takes_no_square_of_time(spark):
    """Half a million words of one text, and as many of repeated ones."""
    long = docs_of(spark, ["x"]).withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500_000)), lambda i: F.concat(F.lit("w"), (i % 300_000).cast("string"))), " "))
    began = time.time()
    r = quality.measured(long).first()
    assert (r.n_words, r.n_repeat_words) == (500_000, 400_000)
    assert time.time() - began < 60
