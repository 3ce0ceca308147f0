"""Exact quantiles without all values in one task.

Of a whole column: counts between approximate quantiles, then between those of the
range that holds the rank, until few values are left in it; a round sends a row for
each range to the driver, the end a bounded number of values. Of many groups: distinct values
are counted, numbered by ranges and prefix sums, and the values at the two ranks
beside a quantile are picked.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.operators.catalog import running_total

#: Ranges of a round; values that are sorted at the end.
RANGES, FEW = 64, 2048


def _values_at(df: DataFrame, value: Column, ranks: list[int], low: float, high: float) -> dict[int, float]:
    """The values of these ranks, from 0, of rows without nulls between ``low`` and ``high``."""
    open_ = {r: (low, high, 0) for r in ranks}  # rank: the range that holds it, and the number of values below
    found: dict[int, float] = {}
    while open_:
        spans = sorted(set(open_.values()))
        inside = [value.between(a, b) for a, b, _ in spans]
        cuts = [F.percentile_approx(F.when(x, value), F.array(*(F.lit(k / (RANGES + 1)) for k in range(1, RANGES + 1))), F.lit(10 * RANGES)).alias(f"c{i}") for i, x in enumerate(inside)]
        cuts = [sorted(set(c)) for c in df.agg(*cuts).first()]
        part, place = F.lit(None).cast("int"), F.lit(0)
        for i, x in enumerate(inside):
            # a cut is a value of the column and a range of its own, so every round leaves fewer values open
            edges = F.array(*map(F.lit, cuts[i]))
            at = 2 * F.size(F.filter(edges, lambda e: e < value)) + F.array_contains(edges, value).cast("int")
            part, place = F.when(x, i).otherwise(part), F.when(x, at).otherwise(place)
        rows = df.select(value.alias("v"), part.alias("part"), place.alias("place")).where("part is not null").groupBy("part", "place").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        counts = {i: sorted((r.a, r.b, r.n) for r in rows if r.part == i) for i in range(len(spans))}
        then = {}
        for rank, span in open_.items():
            below = span[2]
            for a, b, n in counts[spans.index(span)]:
                if below + n > rank:
                    break
                below += n
            if a == b:
                found[rank] = a
            else:
                then[rank] = (a, b, below, n)
        few = {s for s in then.values() if s[3] <= FEW}
        if few:
            near = reduce(Column.__or__, (value.between(a, b) for a, b, *_ in few))
            held = sorted(r.v for r in df.where(near).select(value.alias("v")).collect())  # FEW for each rank at most
            for rank, (a, b, below, n) in list(then.items()):
                if n <= FEW:
                    found[rank] = [v for v in held if a <= v <= b][rank - below]
                    del then[rank]
        open_ = {r: s[:3] for r, s in then.items()}
    return found


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, between its values as ``percentile`` has them; null without any. NaN is left out."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    seen = rows.agg(F.count("*").alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).first()
    if not seen.n:
        return [None] * len(shares)
    places = [q * (seen.n - 1) for q in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    at = _values_at(rows, v, ranks, seen.a, seen.b) if seen.a < seen.b else dict.fromkeys(ranks, seen.a)
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]


def grouped_quantiles(df: DataFrame, group: str, value: str, shares: list[float], names: list[str]) -> DataFrame:
    """(group, names...): exact quantiles of each group, none of whose rows need meet; null values are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = running_total(counts, ["_g", "_v"], F.col("_c"), "_upto")
    sizes = upto.groupBy(F.col("_g").alias("_of")).agg(F.min(F.col("_upto") - F.col("_c")).alias("_start"), F.sum("_c").alias("_n"))
    placed = upto.join(sizes, F.col("_g").eqNullSafe(F.col("_of"))).withColumns({"_last": F.col("_upto") - F.col("_start") - 1, "_first": F.col("_upto") - F.col("_start") - F.col("_c")})
    out = []
    for q, name in zip(shares, names):
        place = F.lit(q) * (F.col("_n") - 1)
        at = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + F.max(place - F.floor(place)) * (high - low)).alias(name))
    return placed.groupBy("_g").agg(*out).withColumnRenamed("_g", group)
