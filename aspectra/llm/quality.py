"""Quality rules: a table of thresholds, compiled into one projection.

Every measure is a count of a text's words, lines or characters. A rule bounds
one count by another in whole percents, so that verdicts need no floating point:
``least * whole <= 100 * part <= most * whole``. All rules become one list of
the names of those that fail, beside the counts, in a single projection: no
shuffle, no join, no function of Python.

Repeated windows of words are found within the row: hashes of words, a hash for
each window, and where some hash stands twice, one sort of (hash, place). Two
different windows of a text are taken as equal if their 64-bit hashes are.

Defined results: null and empty texts, and texts of white space, have zero counts
and fail the base rules; a rule whose whole is 0 holds; repeated rows get equal
answers; null ids stay; an empty table gives no rows; other columns are not read
by ``measured`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import fresh

# Fixed values of the contract.
SPACE, SYMBOLS, WINDOW = r"\x20\x09-\x0D", "#*$%&|<>", 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as at by this be are was from or an have not but you he she they we his her which all had were been a "
    "des les la le et de un une du est que qui dans pour pas sur au par avec plus ce il elle ne se son sa ses ou en aux "
    "der die das und ist nicht ein eine zu den von mit sich auf für im dem es auch aus wie bei wird sind war er sie ich "
    "el los las del y por con una su lo como más pero sus al o"
)
BULLETS = r"\-*•–—"


@dataclass(frozen=True)
class Rule:
    """Bounds of ``part`` in percents of ``whole``; an absent bound always holds."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=5),
    Rule("letter_words", "n_letter_words", "n_words", least=80),
    Rule("capitals", "n_capitals", "n_letters", most=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_letters", "n_capitals", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out a single time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words that lie in windows found twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    at_least_one = F.greatest(F.size(words) - WINDOW + 1, F.lit(1))

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_once(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted))

    def of_sorted(pairs: Column) -> Column:
        same = lambda p, other: F.coalesce(F.get(pairs, other)["h"] == p["h"], F.lit(False))
        twice = F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))
        return _once(F.sort_array(F.transform(twice, lambda p: p["i"])), covered)

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.coalesce(F.least(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = lambda h: F.transform(F.sequence(F.lit(1), at_least_one), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(_once(hashes, lambda h: _once(windows(h), of_windows)))


def measures(text: Column, stop_words: str = STOP_WORDS) -> Column:
    """A struct of COUNTS of a text; null counts as empty."""

    def of_parts(p: Column) -> Column:
        text, words, lines = p["text"], p["words"], p["lines"]
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated(words),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(stop_words.split()))))),
            "n_letter_words": F.regexp_count(text, F.lit(rf"[^{SPACE}\p{{L}}]*\p{{L}}[^{SPACE}]*")),
            "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "n_lines": F.size(lines),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(f"^[{SPACE}]*[{BULLETS}]"))),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(rf"(?:\.\.\.|…)[{SPACE}]*\z"))),
        }
        return F.struct(*(c.cast("long").alias(n) for n, c in counts.items()))

    def parts(t: Column) -> Column:
        words = F.array_remove(F.split(t, f"[{SPACE}]+"), "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
        return F.struct(t.alias("text"), words.alias("words"), lines.alias("lines"))

    return _once(F.coalesce(text, F.lit("")), lambda t: _once(parts(t), of_parts))


def base_failed(count: Callable[[str], Column]) -> Column:
    return (count("n_words") < LEAST_WORDS) | (100 * count("n_repeat_words") > MOST_REPEATED * count("n_words"))


def failed_rules(count: Callable[[str], Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that fail, in the table's order: the table compiled."""

    def fails(rule: Rule) -> Column:
        part, whole, bad = 100 * count(rule.part), count(rule.whole), F.lit(False)
        if rule.least is not None:
            bad = bad | (part < rule.least * whole)
        if rule.most is not None:
            bad = bad | (part > rule.most * whole)
        return bad & (whole > 0)

    return F.array_compact(F.array(*(F.when(fails(r), r.name) for r in rules), F.lit(None).cast("string")))


def verdict(docs: DataFrame, made: str, rules: tuple[Rule, ...] = RULES, stop_words: str = STOP_WORDS) -> DataFrame:
    """The rows with ``made``: their counts, failed rules, base_failed and kept."""

    def judged(m: Column) -> Column:
        count = lambda c: m[c]
        failed, base = failed_rules(count, rules), base_failed(count)
        return F.struct(*(m[c].alias(c) for c in COUNTS), base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"))

    return docs.withColumn(made, _once(measures(F.col("text"), stop_words), judged))


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: str = STOP_WORDS) -> DataFrame:
    """doc_id, all counts, base_failed, kept and failed_rules of every text."""
    return verdict(docs.select("doc_id", "text"), "_made", rules, stop_words).select("doc_id", "_made.*")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: str = STOP_WORDS) -> DataFrame:
    """The rows that pass the base rules and the table, with their columns."""
    made = fresh("_made", docs)
    return verdict(docs, made, rules, stop_words).where(F.col(made)["kept"]).select(*docs.columns)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, texts) that each rule drops beyond the base rules, commonest first; a row for each rule at most."""
    found = measured(docs, rules).where("not base_failed").select(F.explode("failed_rules").alias("rule"))
    return found.groupBy("rule").agg(F.count("*").alias("texts")).orderBy(F.desc("texts"), "rule")
