"""Substring search by an index of trigrams.

Rows are numbered, and every three characters of a lower-cased text give a row
(gram, number); two marks at the end make shorter ends grams as well. The table is
sorted by gram, so that a query's grams are a few row groups by their statistics.
A query of three characters or more meets the postings of its rarest grams, a
shorter one those of all grams that begin with it; the rows that are left are then
verified, so that results are those of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.operators.catalog import enumerate_rows
from aspectra.sources.shared import written

#: Grams of a query that are met; the rest are left to the check of the text.
RAREST = 3
END = "﷐﷐"


def grams_of(text: Column) -> Column:
    """The distinct grams of a lower-cased text."""
    padded = F.concat(text, F.lit(END))
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(places, lambda i: F.substring(padded, i, 3)))).otherwise(F.array().cast("array<string>"))


@dataclass
class TrigramIndex:
    """rows: the table with a number for each row; postings (gram, number) and counts (gram, n), sorted by gram."""

    rows: DataFrame
    postings: DataFrame
    counts: DataFrame
    text: str

    @classmethod
    def of(cls, df: DataFrame, key: str, text: str) -> TrigramIndex:
        """Index the rows of ``df``; null texts are found by nothing but an empty query."""
        rows = enumerate_rows(df, [F.col(key)], "_number").repartitionByRange("_number").sortWithinPartitions("_number")
        rows = written(rows, "indexed-rows")
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        postings = rows.select("_number", low.alias("low")).select(F.explode(grams_of(F.col("low"))).alias("gram"), "_number")
        # a gram of very many rows is cut by number as well
        postings = written(postings.repartitionByRange("gram", "_number").sortWithinPartitions("gram", "_number"), "postings")
        counts = written(postings.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram"), "gram-counts")
        return cls(rows, postings, counts, text)

    def candidates(self, query: str) -> DataFrame | None:
        """The numbers of rows that can contain a lower-cased query; None: all rows."""
        if not query:
            return None
        if len(query) < 3:
            return self.postings.where(F.startswith("gram", F.lit(query))).select("_number").distinct()
        grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
        known = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(grams)).collect()}  # at most a row for each character of the query
        if len(known) < len(grams):
            return self.postings.where(F.lit(False)).select("_number")
        rarest = sorted(grams, key=lambda g: (known[g], g))[:RAREST]
        met = self.postings.where(F.col("gram").isin(rarest)).groupBy("_number").agg(F.count("*").alias("_n"))
        return met.where(F.col("_n") == len(rarest)).select("_number")

    def containing(self, query: str) -> DataFrame:
        """All rows whose text contains the query, whatever the case; without wildcards."""
        low = query.lower()
        near = self.candidates(low)
        rows = self.rows if near is None else self.rows.join(near, "_number", "left_semi").where(F.contains(F.lower(self.text), F.lit(low)))
        return rows.drop("_number")

    def search(self, query: str, order: list[Column], limit: int = 20, offset: int = 0, fits: Column | None = None) -> DataFrame:
        """A page of the rows that contain the query and fit, with the number of all of them: index and check run once."""
        found = self.containing(query.strip())
        found = written(found if fits is None else found.where(fits), "found")
        return found.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))
