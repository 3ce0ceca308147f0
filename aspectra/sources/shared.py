"""Tables in the folder that driver and executors share, and Arrow batches of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the context's own, and in local mode a new folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    own = f"file://{tempfile.mkdtemp(prefix='aspectra-')}"
    context.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table of the shared folder, read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table of :func:`written` that no later plan reads."""
    path = getattr(df, "_written_at", None)
    if path:
        spark = df.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches. The session keeps the bound: plans read it when they run."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """A table for each run of equal keys in rows that come sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for first, last in zip(edges[:-1], edges[1:]):
            held.append(batch.slice(first, last - first))
            if last < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The same rows with many whole groups in a table: about a batch, but never a part of a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(changes[-1]) if len(changes) else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def binary_of(values: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """A binary array whose items are the bytes of ``values`` between ``bounds``, without a copy of each."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * size, np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def values_of(column: pa.ChunkedArray | pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, one item after the other, and how many each item has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), np.diff(ends) // np.dtype(dtype).itemsize
