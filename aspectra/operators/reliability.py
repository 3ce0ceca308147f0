"""Whether product means are signal: split halves, a star baseline, and a matched null."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.constants import SPLIT_REPEATS
from aspectra.functions.scores import hash_uniform
from aspectra.operators.catalog import running_total
from aspectra.operators.profiles import cell_means
from aspectra.operators.quantiles import grouped_quantiles
from aspectra.sources.shared import arrow_map, whole_runs, written

#: Scores of a cell that meet in one task at most, and bits of the random keys by which larger ones are cut.
LARGE_CELL, BIN_BITS = 100_000, 12
HALVES = "model_key string, aspect string, i int, a double, b double"


def average_rank(df: DataFrame, group: str | list[str], value: str, name: str) -> DataFrame:
    """Ranks within groups; ties share the mean of their places. Any number of rows in a few groups: distinct values are counted, and their counts summed by ranges."""
    groups = [group] if isinstance(group, str) else group
    counts = df.groupBy(F.struct(*groups).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = running_total(counts, ["_g", "_v"], F.col("_c"), "_upto")
    starts = upto.groupBy(F.col("_g").alias("_of")).agg(F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    places = upto.join(starts, F.col("_g").eqNullSafe(F.col("_of"))).select("_g", "_v", (F.col("_upto") - F.col("_start") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(places, F.struct(*groups).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def correlations(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Pearson, Spearman, mean gap and number of (x, y) in each group; both columns are ranked in one pass."""
    rows = df.select(*groups, F.col(x).alias("_x"), F.col(y).alias("_y"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows, "pairs")
    sides = F.array(*(F.struct(F.lit(i).alias("_side"), F.col(c).alias("_value")) for i, c in enumerate(("_x", "_y"))))
    ranked = average_rank(rows.select(*groups, "_row", F.inline(sides)), [*groups, "_side"], "_value", "_rank")
    side = lambda c, i: F.max(F.when(F.col("_side") == i, F.col(c)))
    pairs = ranked.groupBy(*groups, "_row").agg(side("_value", 0).alias("_x"), side("_value", 1).alias("_y"), side("_rank", 0).alias("_rx"), side("_rank", 1).alias("_ry"))
    return pairs.groupBy(*groups).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.avg(F.abs(F.col("_x") - F.col("_y"))).alias("mean_abs_gap"))


def agreement(df: DataFrame) -> DataFrame:
    """Pearson, Spearman and mean gap of x and y by aspect."""
    return correlations(df, ["aspect"], "x", "y").withColumnRenamed("n", "products")


def star_baseline(facts: DataFrame, floor: int) -> DataFrame:
    stars = facts.groupBy("model_key").agg(F.avg("rating").alias("y"))
    means = cell_means(facts).where(F.col("n") >= floor).select("model_key", "aspect", F.col("mean").alias("x"))
    return agreement(means.join(stars, "model_key")).withColumn("r_squared", F.col("pearson") * F.col("pearson"))


def _digests(ids: list[str], i: int) -> np.ndarray:
    """The keys of repeat ``i`` that order reviews at random; equal in every run."""
    return np.frombuffer(b"".join(hashlib.md5(f"{x}|{i}".encode()).digest() for x in ids), ">u8").reshape(-1, 2)


def _small_halves(rows: DataFrame, floor: int, repeats: int) -> DataFrame:
    """(model_key, aspect, i, a, b) of cells that fit into a task: a cell's scores meet once, and all cells of a batch are permuted together."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in whole_runs(batches, "cell"):
            names = met.column("cell").combine_chunks().dictionary_encode()  # sorted: codes rise
            names = names if isinstance(names, pa.DictionaryArray) else names.chunk(0)
            sizes = np.bincount(names.indices.to_numpy())
            met = met.filter(pa.array(np.repeat(sizes >= floor, sizes)))
            sizes = sizes[sizes >= floor]
            if not len(sizes):
                continue
            code, starts, half = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, sizes // 2
            cuts = list(zip(starts.tolist(), (starts + half).tolist(), (starts + sizes).tolist()))
            ids, scores = met.column("review_id").to_pylist(), met.column("score").to_numpy()
            a, b = np.empty((len(sizes), repeats)), np.empty((len(sizes), repeats))
            for i in range(repeats):
                keys = _digests(ids, i)
                own = scores[np.lexsort((keys[:, 1], keys[:, 0], code))]
                a[:, i] = [np.add.reduce(own[first:middle]) for first, middle, _ in cuts]  # pairwise sums, as of each cell alone
                b[:, i] = [np.add.reduce(own[middle:last]) for _, middle, last in cuts]
            with np.errstate(invalid="ignore"):
                a, b = a / half[:, None], b / (sizes - half)[:, None]
            at = pa.array(np.repeat(starts, repeats))
            cells = met.select(["model_key", "aspect"]).take(at).combine_chunks()
            out = [*(pa.concat_arrays(c.chunks) for c in cells.columns), pa.array(np.tile(np.arange(repeats, dtype=np.int32), len(sizes))), pa.array(a.ravel()), pa.array(b.ravel())]
            yield pa.RecordBatch.from_arrays(out, ["model_key", "aspect", "i", "a", "b"])

    keyed = rows.withColumn("cell", F.concat_ws("\x1f", "model_key", "aspect")).repartition("cell").sortWithinPartitions("cell")
    return arrow_map(keyed, halve, HALVES)


def _large_halves(rows: DataFrame, sizes: DataFrame, repeats: int) -> DataFrame:
    """The same of cells of any size: sums by ranges of the random keys, then the rows of the one range that holds the middle."""
    bins = 1 << BIN_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            models, aspects, ids, scores = (c.to_pylist() for c in batch.columns)
            where: dict[tuple, list[int]] = {}
            for at, cell in enumerate(zip(models, aspects)):
                where.setdefault(cell, []).append(at)
            for cell, own in where.items():
                sums = held.setdefault(cell, np.zeros((repeats, 2, bins)))
                values = np.array([scores[k] for k in own])
                for i in range(repeats):
                    low = (_digests([ids[k] for k in own], i)[:, 0] >> np.uint64(64 - BIN_BITS)).astype(np.int64)
                    sums[i, 0] += np.bincount(low, minlength=bins)
                    sums[i, 1] += np.bincount(low, values, bins)
        for (model, aspect), sums in held.items():
            for i in range(repeats):
                own = np.flatnonzero(sums[i, 0])
                k = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([model] * k, pa.string()), pa.array([aspect] * k, pa.string()), pa.array(np.full(k, i, np.int32)), pa.array(own), pa.array(sums[i, 0, own].astype(np.int64)), pa.array(sums[i, 1, own])], ["model_key", "aspect", "i", "bin", "c", "s"])

    cell = ["model_key", "aspect", "i"]
    binned = arrow_map(rows, count, "model_key string, aspect string, i int, bin long, c long, s double").groupBy(*cell, "bin").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    upto = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    placed = binned.withColumns({"upto": F.sum("c").over(upto), "sums": F.sum("s").over(upto)}).join(sizes, ["model_key", "aspect"])
    half = F.floor(F.col("n") / 2)
    totals = Window.partitionBy(*cell)
    middle = placed.withColumn("total", F.sum("s").over(totals)).where((F.col("upto") >= half) & (F.col("upto") - F.col("c") < half))
    middle = written(middle.select(*cell, "bin", "n", "total", (half - F.col("upto") + F.col("c")).alias("rest"), (F.col("sums") - F.col("s")).alias("below")), "middles")
    # of each repeat only the rows of its middle range meet
    tries = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("key", F.md5(F.concat("review_id", F.lit("|"), F.col("i").cast("string")).cast("binary")))
    lead = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / (1 << (32 - BIN_BITS))).cast("long")
    near = tries.withColumn("bin", lead).join(middle, [*cell, "bin"])
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("key"))
    first = near.withColumn("_place", place).where(F.col("_place") <= F.col("rest")).groupBy(*cell).agg(F.sum("score").alias("inside"))
    a = F.col("below") + F.coalesce("inside", F.lit(0.0))
    return middle.join(first, cell, "left").select(*cell, (a / half).alias("a"), ((F.col("total") - a) / (F.col("n") - half)).alias("b"))


def split_half(facts: DataFrame, floor: int, repeats: int = SPLIT_REPEATS, large: int = LARGE_CELL) -> DataFrame:
    """Reliability over random halves of each cell, ``repeats`` times; halves follow a hash, so every run draws the same.

    No row is multiplied: a cell's scores meet once, and cells of more than ``large``
    scores don't meet at all.
    """
    rows = facts.select("model_key", "aspect", F.col("review_id").cast("string").alias("review_id"), "score").where("score is not null")
    sizes = rows.groupBy("model_key", "aspect").agg(F.count("*").alias("n")).where((F.col("n") > large) & (F.col("n") >= floor))
    sizes = written(sizes, "large-cells")
    if sizes.isEmpty():
        halves = _small_halves(rows, floor, repeats)
    else:
        halves = _small_halves(rows.join(sizes, ["model_key", "aspect"], "left_anti"), floor, repeats).unionByName(_large_halves(rows.join(sizes, ["model_key", "aspect"], "left_semi"), sizes, repeats))
    each = correlations(halves, ["aspect", "i"], "a", "b")
    out = each.groupBy("aspect").agg(F.max("n").alias("products"), F.avg("spearman").alias("spearman"), F.avg("pearson").alias("pearson"), F.avg("mean_abs_gap").alias("mean_abs_gap"))
    return out.withColumn("spearman_brown", 2 * F.col("spearman") / (1 + F.col("spearman")))


def _observed(facts: DataFrame, floor: int) -> DataFrame:
    cells = cell_means(facts).where(F.col("n") >= floor)
    return cells.groupBy("aspect").agg(F.round(F.avg("n")).cast("long").alias("m"), F.count("*").alias("products"), F.sqrt(F.avg("var")).alias("s"), F.stddev_samp("mean").alias("observed_std"))


def null_spread(facts: DataFrame, floor: int) -> DataFrame:
    """Means of as many draws with the noise within products, for as many products."""
    params = written(_observed(facts, floor), "null-parameters")  # a row for each aspect
    most = params.agg(F.coalesce(F.max("products"), F.lit(0).cast("long")).alias("n")).first().n
    each = facts.sparkSession.range(most).withColumnRenamed("id", "p").join(F.broadcast(params), F.col("p") < F.col("products"))
    draws = each.select("aspect", "s", "p", F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - 1, F.lit(0).cast("long")))).alias("i"))
    key = F.concat_ws("-", "aspect", F.col("i").cast("string"), F.col("p").cast("string"))
    u1, u2 = (F.greatest(hash_uniform(key, s), F.lit(1e-12)) for s in ("n1", "n2"))
    normal = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.pi() * u2)
    means = written(draws.groupBy("aspect", "p").agg(F.avg(5.5 + F.col("s") * normal).alias("mu")), "null-means")
    out = means.groupBy("aspect").agg((F.max("mu") - F.min("mu")).alias("null_range"), F.stddev_pop("mu").alias("null_std"))
    at = grouped_quantiles(means, "aspect", "mu", [0.1, 0.9], ["low", "high"])
    return out.join(at, "aspect").withColumn("null_p90_p10", F.col("high") - F.col("low")).drop("low", "high")


def compare_to_null(facts: DataFrame, floor: int) -> DataFrame:
    return _observed(facts, floor).select("aspect", "observed_std").join(null_spread(facts, floor), "aspect")
