"""Ranked retrieval: minimum requirements over axes, and the catalogue's search."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.constants import AXES
from aspectra.functions.scores import match_percent, shortfall, worst_axis
from aspectra.operators.catalog import enumerate_rows
from aspectra.sources.shared import shared_dir, written


def checked(requirement: dict[str, float]) -> dict[str, float]:
    """Every axis between 1 and 10, or ValueError."""
    missing = [a for a in AXES if a not in requirement]
    if missing:
        raise ValueError(f"missing axes: {missing}")
    bad = {a: v for a, v in requirement.items() if a not in AXES or not 1 <= v <= 10}
    if bad:
        raise ValueError(f"not an axis between 1 and 10: {bad}")
    return requirement


def matched(profiles: DataFrame, needs: list[Column]) -> DataFrame:
    """Gaps, match and worst axis of each wide profile."""
    gaps = [shortfall(n, F.col(a)) for n, a in zip(needs, AXES)]
    out = profiles.withColumns({f"gap_{a}": g for a, g in zip(AXES, gaps)})
    own = [F.col(f"gap_{a}") for a in AXES]
    mean = sum((F.col(a) for a in AXES[1:]), F.col(AXES[0])) / len(AXES)
    return out.withColumns({"match_percent": match_percent(needs, own), "mean_profile": mean, "worst_axis": worst_axis(own)})


def order_keys(decimals: int = 1) -> list[Column]:
    return [F.desc(F.round("match_percent", decimals)), F.desc(F.round("mean_profile", max(2, decimals))), F.col("model_key")]


def rank(profiles: DataFrame, requirement: dict[str, float], limit: int = 10, decimals: int = 1) -> DataFrame:
    """The best matches first: a projection and a top-n, without a shuffle of the profiles. limit 0: all, numbered by ranges."""
    needs = [F.lit(float(checked(requirement)[a])) for a in AXES]
    out = matched(profiles, needs)
    if not limit:
        return enumerate_rows(out, order_keys(decimals), "rank")
    out = out.orderBy(*order_keys(decimals)).limit(limit)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order_keys(decimals))).cast("long"))


def rank_many(profiles: DataFrame, requirements: DataFrame, limit: int) -> DataFrame:
    """Many requirement rows (query_id and need_<axis>) against all profiles; the queries are a given set."""
    out = matched(profiles.crossJoin(F.broadcast(requirements)), [F.col(f"need_{a}") for a in AXES])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order_keys(6)))
    return out.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit)


def search(products: DataFrame, query: str = "", brand: str = "", include_simulated: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of products by review count; ``total`` counts all that fit. Text is matched as it is, without wildcards."""
    fits = F.lit(True)
    if not include_simulated:
        fits = fits & (F.col("simulated") == 0)
    if brand:
        fits = fits & (F.lower("brand") == brand.lower())
    if query.strip():
        fits = fits & F.contains(F.lower("name"), F.lit(query.strip().lower()))
    found = products.where(fits)
    page = found.orderBy(F.desc("reviews_total"), "model_key").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))


@dataclass
class ProfileIndex:
    """Profiles in cells of a grid over the axes, kept apart by cell; bounds: (cell, n, axes' maxima), a row for each cell."""

    profiles: DataFrame
    bounds: DataFrame
    cells: int

    @classmethod
    def of(cls, profiles: DataFrame, levels: int = 4) -> ProfileIndex:
        """Each axis has ``levels`` levels, so there are at most ``levels`` to the fifth cells, whatever the number of profiles."""
        cell = F.lit(0)
        for a in AXES:
            cell = cell * levels + F.least(F.greatest(F.floor((F.col(a) - 1) / 9 * levels), F.lit(0)), F.lit(levels - 1)).cast("int")
        # ranges of cell and key: a cell with very many profiles is cut into several files
        placed = profiles.withColumn("cell", cell).repartitionByRange("cell", "model_key")
        path = f"{shared_dir(profiles.sparkSession)}/profiles-{uuid.uuid4().hex}"
        placed.write.partitionBy("cell").parquet(path)
        kept = profiles.sparkSession.read.schema(placed.schema).parquet(path)
        bounds = written(kept.groupBy("cell").agg(F.count("*").alias("n"), *(F.max(a).alias(a) for a in AXES)), "cell-bounds")
        return cls(kept, bounds, bounds.count())

    def rank_many(self, requirements: DataFrame, limit: int, decimals: int = 6) -> tuple[DataFrame, dict[str, int]]:
        """As :func:`rank_many`, with the numbers of cells there are and were read, for all requirements together.

        No profile of a cell can match better than its maxima would. The cells with
        the best bounds that hold ``limit`` profiles give a requirement's least good match
        so far; cells whose bound is below it are skipped, ties are not.
        """
        needs = [F.col(f"need_{a}") for a in AXES]
        grid = matched(self.bounds.crossJoin(F.broadcast(requirements)), needs)  # cells by given requirements
        grid = grid.select("query_id", "cell", "n", F.round(F.col("match_percent") + 1e-9, decimals).alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell").rowsBetween(Window.unboundedPreceding, -1)
        grid = written(grid.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))), "cell-grid")
        first = self._ranked(grid.where(F.col("before") < limit), requirements, limit, decimals)
        least = first.groupBy("query_id").agg(F.min(F.round("match_percent", decimals)).alias("least"), F.count("*").alias("found"))
        open_ = grid.join(F.broadcast(least), "query_id").where((F.col("bound") >= F.col("least")) | (F.col("found") < limit)).select("query_id", "cell")
        open_ = written(open_, "open-cells")
        seen = {"cells": self.cells, "read": open_.select("cell").distinct().count()}
        return self._ranked(open_, requirements, limit, decimals), seen

    def _ranked(self, cells: DataFrame, requirements: DataFrame, limit: int, decimals: int) -> DataFrame:
        """The best profiles of each requirement among its cells; only files of these are read."""
        wanted = [r.cell for r in cells.select("cell").distinct().collect()]  # cells of the grid at most
        pairs = cells.select("query_id", F.col("cell").alias("_cell")).join(requirements, "query_id")
        rows = self.profiles.where(F.col("cell").isin(wanted)).join(F.broadcast(pairs), F.col("cell") == F.col("_cell"))
        out = matched(rows, [F.col(f"need_{a}") for a in AXES])
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order_keys(decimals)))
        return out.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit).drop("_cell", "cell")
