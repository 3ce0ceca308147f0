"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are a bounded sample of the data. A vector is
described by its DESCRIBED nearest pivots in order, a prefix of its permutation.
Inverted lists hold the vectors under each of their very nearest pivots, so two
vectors meet in a list if one of the first few pivots of each is the other's
too. Within a list, a matrix product of the vectors' pivots counts how many each
two share; those that share SHARED or more are candidates, and every candidate
is verified by the cosine in double precision. Two vectors that meet in several
lists are counted in one, that of their lowest common pivot, so nothing has to
be emitted for a pair: a block returns one sum for each of its vectors and one
edge for each to the smallest of its component there.

A list longer than a block is cut in blocks, and each two of these form a task
of their own; no group of any size lands in one task. Equal vectors are one
class and are compared once. Vectors of a length that few have need no pivots:
they make one list.

The more pivots there are, the more lists hold a vector, so that recall does not
fall as the table grows. At the threshold itself, simulated with 3,000 pairs of
64 random dimensions at a cosine of 0.9: 0.995 with 160 pivots, 0.995 with 450,
0.991 with 1,000, 0.994 with 2,000, 0.993 with 4,096, 0.988 with 10,000.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and stay; vectors of different lengths never link;
repeated rows count as links of each other; ties between pivots go to the lower
number; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import arrow_map, written
from aspectra.llm.components import components

#: Nearest pivots that describe a vector, and how many two candidates share.
DESCRIBED, SHARED = 16, 3
#: Lists that hold a vector, by the largest number of pivots for which they do.
POSTED = ((256, 5), (1024, 6), (2048, 7), (8192, 8))
#: Members of a list that one task compares with as many others.
BLOCK = 1024
PIVOTS = (16, 8192)
PIVOT_BYTES = 64 << 20
#: Vectors of a length from which on it has pivots.
MANY = 1024


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cls) of every row, cls null if it can't link; and (cls, copies, first_id, vector) of the classes."""
    floats = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size(floats) > 0) & ~F.exists(floats, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(floats, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(fine, floats).alias("vector")).withColumn("cls", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("vector").alias("vector"))
    return rows.select("vec_id", "cls"), classes


def _matrix(column: pa.Array) -> np.ndarray:
    """Normalised rows of equal length."""
    rows = np.array(column.to_pylist(), np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)  # large components don't overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def posted_in(pivots: int) -> int:
    """How many lists hold a vector."""
    return min(pivots, next((m for most, m in POSTED if pivots <= most), POSTED[-1][1]))


def pivots_for(n: int, width: int) -> int:
    """Pivots with which finding them costs about as much as comparing lists, within the bounds."""
    return int(min(PIVOTS[1], PIVOT_BYTES // (8 * width), max(PIVOTS[0], 4 * n**0.5)))


def nearest(own: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first."""
    near, k = own @ pivots.T, min(DESCRIBED, len(pivots))
    few = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.broadcast_to(np.arange(k), near.shape)
    few = np.sort(few, 1)  # ties go to the lower number
    order = np.argsort(-np.take_along_axis(near, few, 1), axis=1, kind="stable")
    return np.take_along_axis(few, order, 1).astype(np.int32)


def described(classes: DataFrame, pivots: np.ndarray | None, width: int | None) -> DataFrame:
    """cls, copies, the normalised vector and its nearest pivots in order as bytes, and the lists it stands in; without pivots, one list for its length."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)
    rows = classes if width is None else classes.where(F.size("vector") == width)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if reference is None:
                own = [_matrix(pa.array([x]))[0] for x in batch.column(2).to_pylist()]
                order = np.zeros((len(own), 0), np.int32)
                keys = [[-len(x)] for x in own]
            else:
                own = _matrix(batch.column(2))
                order = nearest(own, reference)
                keys = order[:, : posted_in(len(reference))].tolist()
            columns = [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in own], pa.binary()), pa.array([r.tobytes() for r in order], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "copies", "vector", "pivots", "keys"])

    return arrow_map(rows.select("cls", "copies", "vector"), describe, "cls long, copies long, vector binary, pivots binary, keys array<long>")


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row, from pairs (x, y)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return label


def candidates(pivots: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each row of ``left`` and of ``right`` share enough pivots, by a matrix product of who has which."""
    if not pivots.shape[1]:
        return np.ones((len(left), len(right)), bool)
    distinct, column = np.unique(pivots, return_inverse=True)
    has = np.zeros((len(pivots), len(distinct)), np.float32)
    np.put_along_axis(has, column.reshape(pivots.shape), 1, 1)
    return has[left] @ has[right].T >= min(SHARED, pivots.shape[1])


def compare(key: int, posted: int, copies: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, side: np.ndarray, across: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block that belong to this list, as copies linked to each row; and each row's local root."""
    left = np.flatnonzero(side == 0) if across else np.arange(len(copies))
    right = np.flatnonzero(side == 1) if across else left
    open_ = candidates(pivots, left, right)
    if not across:
        open_ = np.triu(open_, 1)
    if open_.mean() > 0.05:
        x, y = np.nonzero(open_ & (vectors[left] @ vectors[right].T >= least))
    else:
        x, y = np.nonzero(open_)
        near = [np.einsum("ij,ij->i", vectors[left[x[i : i + 4096]]], vectors[right[y[i : i + 4096]]]) >= least for i in range(0, len(x), 4096)]
        good = np.concatenate(near) if near else np.zeros(0, bool)
        x, y = x[good], y[good]
    x, y = left[x], right[y]
    sums = np.zeros(len(copies), np.int64)
    for first in range(0, len(x), 1 << 17):
        a, b = x[first : first + (1 << 17)], y[first : first + (1 << 17)]
        if key >= 0:
            one, two = pivots[a, :posted], pivots[b, :posted]
            common = np.where((one[:, :, None] == two[:, None, :]).any(2), one, np.iinfo(np.int32).max)
            own = common.min(1) == key
            a, b = a[own], b[own]
        np.add.at(sums, a, copies[b])
        np.add.at(sums, b, copies[a])
    return sums, local_roots(len(copies), x, y) if len(x) else np.arange(len(copies))


def links_within(blocks: DataFrame, least: float, posted: int) -> DataFrame:
    """Compare the rows of each (key, low, high); they come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
            codes = np.column_stack([table.column(c).to_numpy() for c in ("key", "low", "high")])
            edges = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]).any(1), [True])))
            cls, copies, side = (table.column(c).to_numpy() for c in ("cls", "copies", "side"))
            raw, near = table.column("vector").to_pylist(), table.column("pivots").to_pylist()
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                vectors = np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, -1)
                pivots = np.frombuffer(b"".join(near[a:b]), np.int32).reshape(b - a, -1)
                sums, roots = compare(int(codes[a, 0]), posted, copies[a:b], vectors, pivots, side[a:b], codes[a, 1] != codes[a, 2], least)
                hit = np.flatnonzero((sums > 0) | (roots != np.arange(b - a)))
                for part, values in zip(out, (cls[a:b][hit], sums[hit], cls[a:b][roots[hit]])):
                    part.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in out], ["cls", "linked", "root"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # all but the last group are whole
            last = [held.column(c)[-1].as_py() for c in ("key", "low", "high")]
            same = np.ones(held.num_rows, bool)
            for c, v in zip(("key", "low", "high"), last):
                same &= held.column(c).to_numpy() == v
            cut = int(np.argmax(same))
            if cut:
                yield from judged(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from judged(held)

    return arrow_map(blocks, run, "cls long, linked long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.9, pivot_count: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows, classes = classes_of(vectors)
    rows, classes = written(rows, "vectors"), written(classes, "vector-classes")
    found = None
    sizes = classes.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    many = sizes.where(F.col("n") > MANY).orderBy("width").collect()  # as many lengths as have so many vectors
    for width, n in many:
        part = links(described(classes, *pivots_of(classes, width, n, pivot_count)), least, posted_in(pivot_count or pivots_for(n, width)))
        found = part if found is None else found.unionByName(part)
    few = classes.join(F.broadcast(sizes.where((F.col("n") > 1) & (F.col("n") <= MANY)).select("width")), F.size("vector") == F.col("width"), "left_semi")
    if not few.isEmpty():
        part = links(described(few, None, None), least, 0)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "vector-links")
    sums = found.groupBy("cls").agg(F.sum("linked").alias("linked"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("a", "cls")
    named = classes.select("cls", "copies", "first_id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(first, "root").join(sums, "cls", "left").select("cls", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    key = F.coalesce("cls", F.xxhash64("vec_id"))
    joined = rows.select("vec_id", key.alias("cls"), F.col("cls").isNotNull().alias("_fine")).join(written(named, "vector-names"), "cls", "left")
    component = F.when(F.col("_fine"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    count = F.when(F.col("_fine"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("vec_id", count.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def pivots_of(classes: DataFrame, width: int, n: int, count: int | None = None) -> tuple[np.ndarray, int]:
    """The pivots among n vectors of a length: a bounded sample by hash."""
    count = count or pivots_for(n, width)
    at = F.pmod(F.xxhash64(F.col("cls") + 1), F.lit(1 << 52))
    # only about twice as many as wanted reach the driver's merge
    under = classes.where((F.size("vector") == width) & (at < int(min(1.0, (2 * count + 100) / n) * (1 << 52))))
    return _matrix(under.orderBy(at, "cls").limit(count).select("vector").toArrow().column(0)), width


def links(index: DataFrame, least: float, posted: int) -> DataFrame:
    """(cls, linked, root): per block and row, copies linked and an edge to the block's smallest."""
    index = written(index, "pivot-index", "none")
    slim = index.select("cls", F.explode("keys").alias("key"))
    sizes = slim.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = slim.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "cls", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    blocks = dealt.join(index.drop("keys"), "cls").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return links_within(blocks.select("key", "low", "high", "side", "cls", "copies", "vector", "pivots"), least, posted)
