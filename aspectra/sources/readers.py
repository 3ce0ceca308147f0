"""Scans: CSV, JSON, annotated lines, uploads, YAML-like tables, model folders. All by Spark's readers."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra.constants import ASPECTS
from aspectra.sources.shared import arrow_map

REVIEW_HEADERS = ("review", "text", "body", "comment", "content")


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Header, quoted line breaks and doubled quotes; malformed rows keep their text in ``_corrupt_record``."""
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return spark.read.schema(f"{schema}, _corrupt_record string").options(**options).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def read_splits(spark: SparkSession, folder: str, prefix: str, splits: tuple[str, ...], schema: str) -> DataFrame:
    """All splits of a dataset; FileNotFoundError if one is missing."""
    paths = [f"{folder}/{prefix}_{s}.csv" for s in splits]
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing splits: {missing}")
    return read_csv(spark, paths, schema)


def count_rows(spark: SparkSession, path: str | list[str]) -> int:
    """Records below the header of CSV files, line breaks within quotes not counted, empty lines neither.

    Files are read by byte ranges, whatever they hold: each range gives its parity of
    quotes and the records that end in it for both parities before it, and a prefix
    sum over a file's ranges says which of the two holds. Quotes are those of
    RFC 4180: around whole fields, doubled inside.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"), (F.col("value") == "").alias("empty"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parity, ends = None, 0, [0, 0]
        names = ["file", "start", "parity", "after_even", "after_odd"]
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, parity, *ends)], names)
        for batch in batches:
            files, starts, quotes, empty = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), len(files)]):
                if first == end:
                    continue
                place = (files[first], int(starts[first]))
                if place != held:
                    if held is not None:
                        yield out()
                    held, parity, ends = place, 0, [0, 0]
                after = (parity + np.cumsum(quotes[first:end])) % 2
                before = np.append(parity, after[:-1])
                for state in (0, 1):
                    done = (after ^ state) == 0
                    ends[state] += int((done & ~(empty[first:end] & ((before ^ state) == 0))).sum())
                parity = int(after[-1])
        if held is not None:
            yield out()

    found = arrow_map(lines, ranges, "file string, start long, parity long, after_even long, after_odd long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    state = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2
    records = found.withColumn("n", F.when(state == 0, F.col("after_even")).otherwise(F.col("after_odd")))
    # a file that ends within quotes has one more record, and the first is its header
    files = records.groupBy("file").agg((F.sum("n") + F.sum("parity") % 2).alias("n"))
    return files.agg(F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("n")).first().n


def read_reports(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """JSON files that hold an object or a list of them; malformed ones are skipped."""
    reader = spark.read.options(multiLine=True, mode="DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(glob)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An optional JSON file: empty, with a warning, where it is missing or can't be read."""
    try:
        df = spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)
        df.limit(1).collect()
        return df
    except Exception as error:  # noqa: BLE001  any fault of an optional file
        if not isinstance(error, AnalysisException):
            warnings.warn(f"{path} can't be read: {type(error).__name__}", stacklevel=2)
        return spark.createDataFrame([], schema)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, line_number): lines numbered from 1 in each file, which is read by byte ranges.

    Lines are numbered within their range, and a prefix sum over a file's ranges, a
    row each, gives the numbers before it.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("_start"), F.monotonically_increasing_id().alias("_at"))
    inside = F.row_number().over(Window.partitionBy("file", "_start").orderBy("_at"))  # a range has a split's bytes at most
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "_start").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.withColumn("_inside", inside).join(sizes, ["file", "_start"]).select("value", "file", (F.col("_before") + F.col("_inside")).alias("line_number"))


def read_annotated(spark: SparkSession, path: str | list[str], domain: str, split: str) -> DataFrame:
    """``text####[[term, category, polarity], ...]`` lines with their file, and a number by place in it."""
    return numbered_lines(spark, path).withColumns({"domain": F.lit(domain), "split": F.lit(split)})


def load_taxonomy(spark: SparkSession, tables: dict[str, dict[str, str]]) -> DataFrame:
    """Mapping tables as one dimension (kind, source, aspect); ValueError for targets that are no aspect."""
    rows = [(kind, source, aspect) for kind, table in tables.items() for source, aspect in table.items()]
    unknown = sorted({a for _, _, a in rows if a not in ASPECTS})
    if unknown:
        raise ValueError(f"unknown aspects: {unknown}")
    return spark.createDataFrame(rows, "kind string, source string, aspect string")


# The mapping tables of a taxonomy file.
TAXONOMY_TABLES = ("attribute_overrides", "product_attribute_map", "phone_map", "laptop_map")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The mapping tables of a YAML taxonomy as one dimension, checked; other keys are not read."""
    import yaml

    content = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}
    return load_taxonomy(spark, {name: content[name] for name in TAXONOMY_TABLES if content.get(name)})


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of an upload: the review-like column of a CSV file with a header, else a line each."""
    first = spark.read.text(path).limit(1).collect()
    names = [c.strip().strip('"').lower() for c in first[0].value.split(",")] if first else []
    column = next((i for i, c in enumerate(names) if c in REVIEW_HEADERS), None)
    if column is None:
        out = spark.read.text(path).select(F.trim("value").alias("text"))
    else:
        rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
        out = rows.select(F.trim(F.col(f"`{rows.columns[column]}`")).alias("text"))
    return out.where(F.col("text").isNotNull() & (F.col("text") != ""))


def load_model(spark: SparkSession, folder: str):  # noqa: ANN201
    """A fitted model with its description; both must be there."""
    from aspectra.operators.scoring import LinearModel

    if not (exists(spark, f"{folder}/about") and exists(spark, f"{folder}/terms")):
        raise FileNotFoundError(f"{folder} has no complete model")
    return LinearModel.load(spark, folder)


def resolve_stage(preference: str, available: dict[str, bool], scores: dict[str, float]) -> str:
    """The model for a stage: the one asked for, or the best of those available."""
    have = [m for m, ok in available.items() if ok]
    if preference != "auto":
        if preference not in have:
            raise ValueError(f"{preference} is not available")
        return preference
    if not have:
        raise ValueError("no model is available")
    return max(sorted(have), key=lambda m: scores.get(m, float("-inf")))
