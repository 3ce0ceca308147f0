"""Best-fit packing of documents into sequences, after dominance reduction.

Lengths are integers up to the capacity, so an instance is a histogram of at
most ``capacity`` counts whatever the number of documents. The plan is made on
that histogram: first the dominance rules of Martello and Toth fix sets that no
alternative beats, then best-fit decreasing packs the rest, many equal items in
one step. Each step says for a range of ranks within one length where its items
go; documents find their place by (length, rank).

Defined results: null or empty text is its end token alone; repeated rows are
packed each for itself, ties broken by a hash and document id (the places of
equal lengths are interchangeable); an empty table gives no rows; other columns
are not read. Texts of any length are cut into pieces of the capacity.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import arrow_map, written
from aspectra.llm.tokens import codec

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STEPS = "length long, first_rank long, last_rank long, per_bin long, first_bin long, first_offset long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of at most ``capacity`` tokens of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, ids in own.encode(batch.column(1).to_pylist()):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_ids[i], piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select("doc_id", "text"), cut, PIECES)


class Plan:
    """Steps of a packing: ranks of a length in a row of bins, ``per_bin`` in each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        if any(not 0 < length <= capacity for length in counts):
            raise ValueError("lengths must lie between 1 and the capacity")
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.bins = 0
        self.fixed_bins = 0
        self.steps: list[tuple[int, int, int, int, int, int]] = []

    def _take(self, length: int, bins: int, per_bin: int, first_bin: int, offset: int) -> None:
        n = bins * per_bin
        self.steps.append((length, self.used[length], self.used[length] + n, per_bin, first_bin, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, *lengths: int) -> None:
        """Fill as many bins with this set as its items allow."""
        bins = min(self.left[length] // lengths.count(length) for length in set(lengths))
        if not bins:
            return
        offset = 0
        for length in dict.fromkeys(lengths):
            per_bin = lengths.count(length)
            self._take(length, bins, per_bin, self.bins, offset)
            offset += per_bin * length
        self.bins += bins
        self.fixed_bins += bins

    def _dominating(self, length: int, sizes: list[int]) -> tuple[int, ...] | None:
        """A set with ``length`` that dominates every other set with it; None if the rules find none.

        sizes: the lengths left, ascending, ``length`` itself included.
        """
        room = self.capacity - length
        spare = lambda size: self.left[size] - (size == length)
        small: list[int] = []
        for size in sizes:
            small += [size] * min(3, spare(size))
            if len(small) >= 3:
                break
        if not small or small[0] > room:
            return (length,)
        if self.left.get(room, 0) and spare(room) > 0:
            return (length, room)
        at = bisect_left(sizes, room + 1) - 1
        while at >= 0 and spare(sizes[at]) <= 0:
            at -= 1
        if at < 0:
            return (length,)
        best = sizes[at]
        if len(small) < 2 or small[0] + small[1] > room:
            return (length, best)
        if len(small) < 3 or sum(small[:3]) > room:
            pair, low, high = 0, 0, at
            while low <= high:  # the largest sum of two that fits
                total = sizes[low] + sizes[high]
                if total > room:
                    high -= 1
                elif low == high and spare(sizes[low]) < 2 or spare(sizes[low]) < 1 or spare(sizes[high]) < 1:
                    if spare(sizes[low]) < 1:
                        low += 1
                    else:
                        high -= 1
                else:
                    pair = max(pair, total)
                    low += 1
            if best >= pair:
                return (length, best)
        return None

    def reduce(self) -> None:
        """Fix dominating sets until none is left to find."""
        changed = True
        while changed and self.left:
            changed = False
            sizes = sorted(self.left)
            for length in sizes[::-1]:
                while self.left.get(length):
                    found = self._dominating(length, sizes)
                    before = self.bins
                    if found:
                        self._fix(*found)
                    if self.bins == before:
                        break
                    changed = True
                    for gone in set(found):
                        if gone not in self.left:
                            sizes.pop(bisect_left(sizes, gone))

    def best_fit(self) -> None:
        """Best-fit decreasing over what is left. A bin takes equal items for as long as they fit, as item by item."""
        rooms: dict[int, list[tuple[int, int]]] = {}  # free room: (first bin, bins)
        order: list[int] = []

        def put(room: int, first: int, bins: int) -> None:
            if room <= 0 or not bins:
                return
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((first, bins))

        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                at = bisect_left(order, length)
                if at < len(order):
                    room = order[at]
                    first, bins = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        order.pop(at)
                else:
                    room, first = self.capacity, self.bins
                    per_bin = room // length
                    bins = -(-n // per_bin)
                    self.bins += bins
                per_bin = room // length
                full = min(bins, n // per_bin)
                if full:
                    self._take(length, full, per_bin, first, self.capacity - room)
                    put(room - per_bin * length, first, full)
                rest = self.left.get(length, 0)
                if full < bins:
                    if rest and rest < per_bin:
                        self._take(length, 1, rest, first + full, self.capacity - room)
                        put(room - rest * length, first + full, 1)
                        full += 1
                    put(room, first + full, bins - full)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    out = Plan(counts, capacity)
    out.reduce()
    out.best_fit()
    return out


def pack(pieces: DataFrame, capacity: int = 4096, blocks: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length``.

    The driver gets one count for each length, at most ``capacity`` of them.
    Ranks within a length are counted in ``blocks`` hash blocks and joined by
    prefix sums, so that a very common length is spread over many tasks.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan(counts, capacity).steps
    where = F.broadcast(spark.createDataFrame(steps, STEPS))
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    sizes = dealt.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_row", F.row_number().over(inside) - 1).join(bases, ["length", "_block"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row"))
    s = where.withColumnRenamed("length", "_length")
    step = F.col("_rank") - F.col("first_rank")
    placed = ranked.join(s, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("last_rank")))
    return placed.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(step / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (step % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack whole documents; only those longer than ``capacity`` are cut."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
