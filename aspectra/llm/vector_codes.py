"""Product quantisation with a delta-maintained Lloyd's algorithm.

Vectors are integers, floor(256 x), cut into equal parts; each part position has
a codebook. A round assigns every part to the nearest entry and moves the entries
to the floor of their parts' means. Assignments are kept in a table from round to
round, and the sums and counts of every entry go on from the round before: only
parts whose entry changed contribute, minus their values where they were and plus
where they are. Contributions are summed within tasks first, so a round's shuffle has at
most a row for each task, part and entry, however many parts changed, and none for
those that stay. Only the sums of the entries (parts times entries, a fixed
number) come to the driver.

Integers make all of it exact in any order of rows and tasks. Distances are worked
out by matrix products in double precision where all values are small enough for
these to be exact, otherwise in 64-bit integers.

Defined results: vectors that are null or hold null or non-finite components are
dropped; so are those of another length than the smallest vec_id's; components
beyond 2**17 either way count as at that bound, so that distances fit into longs;
the last parts are padded with zeros where the length can't be cut evenly; with fewer vectors
than entries a codebook has as many entries as there are vectors; of equal vec_ids
the smaller vector comes first; null vec_ids come last; repeated rows get equal
codes; null labels are one label; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import arrow_map, drop_written, written, written_with

# Fixed values of the contract.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Largest integer of a component.
BOUND = 1 << 25
#: Below this, products and sums of a part are exact in double precision.
EXACT = 1 << 21
#: Rows of labels that are sent to all tasks at most.
SENT = 200_000
SALTS = 16
STATE = "vec_id {id}, label {label}, x array<int>, was binary, code binary, error long"


@dataclass
class Codebooks:
    """entries: (parts, entries, width); sums and counts of the parts assigned so far."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        """From integer vectors (entries, parts x width)."""
        entries = np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2))
        return cls(entries, np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64))

    def moved(self) -> Codebooks:
        """Entries at the floor of their parts' means; unused ones stay."""
        used = self.counts > 0
        means = self.sums // np.maximum(self.counts, 1)[..., None]
        return Codebooks(np.where(used[..., None], means, self.entries), self.sums, self.counts)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entry numbers, the lowest of equal ones, and each row's squared distances summed."""
        parts, _, width = self.entries.shape
        x = x.reshape(len(x), parts, width)
        code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        small = max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0)) < EXACT
        for p in range(parts):
            own, entries = x[:, p], self.entries[p]
            if small:
                a, b = own.astype(np.float64), entries.astype(np.float64)
                far = (b * b).sum(1) - 2 * (a @ b.T)
                best = far.argmin(1)
                away = (a * a).sum(1) + far[np.arange(len(a)), best]
            else:
                best, away = np.zeros(len(own), np.int64), None
                for k, entry in enumerate(entries):
                    d = ((own - entry) ** 2).sum(1)
                    best = best if away is None else np.where(d < away, k, best)
                    away = d if away is None else np.minimum(away, d)
            code[:, p] = best
            error += away.astype(np.int64)
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _integers(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, x) of the vectors that count, as arrays of integers of a length that ``parts`` divides."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").where(v.isNotNull() & ~bad & (F.size(v) > 0))
    scaled = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(BOUND)), F.lit(-BOUND)).cast("int"))
    width = F.ceil(F.size(v) / parts).cast("int") * parts
    padded = F.concat(scaled, F.array_repeat(F.lit(0), width - F.size(v)))
    return rows.select("vec_id", "label", padded.alias("x"))


def _assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with new codes and errors; the codes they had become ``was``."""
    schema = STATE.format(id=rows.schema["vec_id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())
    names, first, parts = ["vec_id", "label", "x", "was", "code", "error"], "code" not in rows.columns, len(books.entries)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, x = batch.columns[:3]
            n = batch.num_rows
            code, error = books.nearest(x.flatten().to_numpy().reshape(n, -1).astype(np.int64) if n else np.zeros((0, books.entries[:, 0].size), np.int64))
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), n, [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            was = pa.nulls(n, pa.binary()) if first else batch.column(3)
            yield pa.RecordBatch.from_arrays([ids, labels, x, was, codes, pa.array(error)], names)

    return arrow_map(rows.select(*names[:3]) if first else rows.select(*names[:3], "code"), assign, schema)


def _changes(state: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, sums, count): what the parts whose entry changed add to the entries, summed in each task and over all."""
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x, was, code = batch.columns
            n = batch.num_rows
            if not n:
                continue
            x = x.flatten().to_numpy().reshape(n, parts, width)
            now = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            before = np.full_like(now, -1) if was.null_count else np.frombuffer(b"".join(was.to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            row, part = np.nonzero(now != before)
            values = x[row, part].astype(np.int64)
            for sign, entry in ((1, now[row, part]), (-1, before[row, part])):
                there = entry >= 0
                cell = (part * entries + entry)[there]
                np.add.at(sums, cell, sign * values[there])
                np.add.at(counts, cell, sign)
        cell = np.flatnonzero(counts.astype(bool) | sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(list(sums[cell]), pa.list_(pa.int64())), pa.array(counts[cell])], ["cell", "sums", "n"])

    rows = arrow_map(state.select("x", "was", "code"), add, "cell long, sums array<long>, n long")
    total = F.array(*(F.sum(F.col("sums")[i]) for i in range(width)))
    return rows.groupBy("cell").agg(total.alias("sums"), F.sum("n").alias("n"))


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the vectors with the smallest ids; None without any vector."""
    found = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # as many rows as entries
    found = [r.x for r in found if len(r.x) == len(found[0].x)]
    return Codebooks.of(np.array(found, np.int64), parts) if found else None


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks] | None:
    """The last assignments (vec_id, label, x, was, code, error) as a table, and the codebooks; None without any vector."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is one byte")
    rows = _integers(vectors, parts)
    books = first_books(rows, parts, entries)
    if books is None:
        return None
    state = rows.where(F.size("x") == books.entries.shape[0] * books.entries.shape[2])
    for r in range(rounds + 1):
        before, state = state, written(_assigned(state, books), "codes")
        if r:
            drop_written(before)
        if r == rounds:
            break
        for change in _changes(state, books).collect():  # parts x entries rows at most
            p, k = divmod(change.cell, books.entries.shape[1])
            books.sums[p, k] += np.array(change.sums, np.int64)
            books.counts[p, k] += change.n
        books = books.moved()
    return state, books


def _with_label_errors(codes: DataFrame) -> DataFrame:
    """The rows with the sum of their label's errors: summed within tasks, sent where labels are few, else met by label and salt."""
    sums, seen = written_with(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors", F.count(F.lit(1)).alias("n"))
    if seen["n"] <= SENT:
        return codes.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    copies = sums.withColumn("_of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("_salt") == F.col("_of_salt"))).drop("of", "_salt", "_of_salt")


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code as hex digits, squared error, the error of its label, and the digest of all codebooks."""
    made = train(vectors, parts, entries, rounds)
    if made is None:
        empty = vectors.where(F.lit(False))
        return empty.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    state, books = made
    codes = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    return _with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, approximated): the entries that a code (hex digits) names, as numbers of the scale of the vectors."""
    parts = len(books.entries)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(-1, parts)
            near = books.entries[np.arange(parts), code].reshape(len(code), -1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(near), pa.list_(pa.float64()))], ["vec_id", "approximated"])

    return arrow_map(codes.select("vec_id", "code"), look_up, f"vec_id {codes.schema['vec_id'].dataType.simpleString()}, approximated array<double>")


def twin(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, every round over all parts; for vectors of one length that ``parts`` divides, and distinct ids."""
    floors = f"list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE)*{SCALE}) AS BIGINT))"
    ctes = [f"v AS MATERIALIZED (SELECT vec_id, label, {floors} AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0)"]
    ctes.append(f"p AS MATERIALIZED (SELECT vec_id, part, x[part*(len(x)//{parts})+1:(part+1)*(len(x)//{parts})] AS y FROM v, (SELECT unnest(range({parts})) AS part))")
    ctes.append(f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id)-1 AS entry, y AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))")
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(y,c), lambda z: (z[1]-z[2])*(z[1]-z[2])))"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p.part AS part, min({far}*{entries}+entry) AS best, any_value(y) AS y FROM p JOIN b{r} b ON b.part=p.part GROUP BY 1,2)")
        if r < rounds:
            each = f"SELECT part, CAST(best%{entries} AS BIGINT) AS entry, i, sum(y[i]) AS s, count(*) AS n FROM (SELECT part, best, y, unnest(range(1,len(y)+1)) AS i FROM a{r}) GROUP BY 1,2,3"
            means = f"SELECT part, entry, list(CAST(floor_div(s,n) AS BIGINT) ORDER BY i) AS c FROM ({each}) GROUP BY 1,2".replace("floor_div(s,n)", "(s - ((s%n)+n)%n)//n")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT o.part AS part, o.entry AS entry, coalesce(m.c,o.c) AS c FROM b{r} o LEFT JOIN ({means}) m ON m.part=o.part AND m.entry=o.entry)")
    ctes.append(f"e AS (SELECT vec_id, string_agg(printf('%02x', CAST(best%{entries} AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best//{entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    digest = f"(SELECT sha256(string_agg(array_to_string(c,','),',' ORDER BY part, entry)) FROM b{rounds})"
    return f"WITH {', '.join(ctes)} SELECT e.vec_id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM e JOIN v ON v.vec_id=e.vec_id"
