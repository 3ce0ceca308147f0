"""Sentence units as table functions: for SQL's LATERAL, and over a partitioned table.

The rules are those of :func:`aspectra.functions.text.split_sentences`, whose plan
stays in the engine; a table function gives them to SQL, with numbers of words as
further arguments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from aspectra.constants import UNIT_MAX_WORDS, UNIT_MIN_WORDS
from aspectra.functions import text as X

#: The white space of the rules, as a class without property escapes.
SPACE = X.SPACE.replace(r"\p{Z}", " \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")
_EDGES = re.compile(f"^[{SPACE}]+|[{SPACE}]+\\Z")
_GAPS = re.compile(f"[{SPACE}]+")
_ENDS = re.compile(f"(?:{X.TERMINATOR})[{SPACE}]+")
_ABBREVIATED = re.compile(f"(?<![A-Za-z.])\\.*(?ai:{X._ABBREVIATED}){X.TERMINATOR}[{SPACE}]+\\Z")
_BULLETS = re.compile(f"^[{X.BULLETS}]+[{SPACE}]*")
_COMMAS = re.compile(f"(?<=,)[{SPACE}]+")


def words_of(text: str) -> list[str]:
    return [w for w in _GAPS.split(text) if w]


def _sentences(line: str, least: int) -> list[str]:
    """Pieces of a line between sentence ends; one that is too short goes to the piece before it, the first to the one after."""
    pieces, first = [], 0
    for end in _ENDS.finditer(line):
        if not _ABBREVIATED.search(line, 0, end.end()):
            pieces.append(line[first : end.end()])
            first = end.end()
    pieces.append(line[first:])
    joined: list[str] = []
    for piece in filter(None, (_EDGES.sub("", p) for p in pieces)):
        if joined and len(words_of(piece)) < least:
            joined[-1] += f" {piece}"
        else:
            joined.append(piece)
    if len(joined) > 1 and len(words_of(joined[0])) < least:
        joined[:2] = [f"{joined[0]} {joined[1]}"]
    return joined


def _cut(unit: str, most: int) -> Iterator[str]:
    """Clauses taken up while they fit; longer runs of words are cut."""
    held: list[str] = []
    for clause in map(words_of, _COMMAS.split(unit)):
        if held and len(held) + len(clause) > most:
            yield " ".join(held)
            held = []
        held += clause
        while len(held) > most:
            yield " ".join(held[:most])
            held = held[most:]
    if held:
        yield " ".join(held)


def units_of(text: str | None, least: int = UNIT_MIN_WORDS, most: int = UNIT_MAX_WORDS) -> list[str]:
    """The units of a text: one at least, none of a blank one."""
    bare = _EDGES.sub("", text or "")
    if not bare:
        return []
    lines = (_BULLETS.sub("", _EDGES.sub("", x)) for x in re.split(r"[\r\n]+", bare))
    units = [u for x in lines if x for u in _sentences(x, least)]
    short = [c for u in units for c in (_cut(u, most) if len(words_of(u)) > most else (u,))]
    return short or [bare]


class SentenceUnits:
    """``LATERAL sentence_units(text [, least [, most]])``: (position, unit)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, least: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        for number in (least, most):
            if number is not None and (not number.isConstantExpression or not isinstance(number.value, int) or number.value < 1):
                raise ValueError("numbers of words are constants of 1 or more")
        if not isinstance(text.dataType, T.StringType | T.NullType):
            raise ValueError("units are made of text")
        return AnalyzeResult(T.StructType().add("position", T.LongType()).add("unit", T.StringType()))

    def eval(self, text: str | None, least: int = UNIT_MIN_WORDS, most: int = UNIT_MAX_WORDS) -> Iterator[tuple]:
        yield from enumerate(units_of(text, least, most))


class UnitsOfTable:
    """``units_of_table(TABLE(...) PARTITION BY key)``: of rows whose first column is a key and whose second is text, (key, position, unit), numbered on through all texts of a key."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("a table of a key and a text is wanted")
        return AnalyzeResult(T.StructType().add("key", rows.dataType.fields[0].dataType).add("position", T.LongType()).add("unit", T.StringType()))

    def __init__(self) -> None:
        self.made = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for unit in units_of(row[1]):
            yield row[0], self.made, unit
            self.made += 1


def register(spark: SparkSession) -> None:
    """Both functions under their names in SQL."""
    spark.udtf.register("sentence_units", F.udtf(SentenceUnits))
    spark.udtf.register("units_of_table", F.udtf(UnitsOfTable))
