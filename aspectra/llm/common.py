"""What the operators of this subpackage share: tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch between the JVM and a Python worker; wide rows then do not pile up.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader (any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 4000) -> None:
    """Bound what one Arrow batch holds. The session keeps the bound: plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
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
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._aspectra_path = path
    return out


def written_with(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """As :func:`written`, with aggregates of the rows that were written.

    They are read from the table, so a task that runs twice counts once and the
    session holds nothing that fitted models could take along.
    """
    out = written(df, name)
    return out, out.agg(*measures).first().asDict()


def drop_written(df: DataFrame) -> None:
    """Remove a table of :func:`written` that no later plan reads."""
    path = getattr(df, "_aspectra_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def crc_fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % modulus


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come sorted by ``keys``; only the last group is held back."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        same = np.ones(held.num_rows, bool)
        for key in keys:
            column = held.column(key).to_numpy()
            same &= column == column[-1]
        cut = int(np.argmax(same))
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()
