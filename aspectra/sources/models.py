"""Model folders: whether they are complete, promotion to the served place, and the way back."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from aspectra.sources.readers import exists

REQUIRED = ("metadata.json", "model")


def faults(spark: SparkSession, folder: str) -> list[str]:
    """What a model folder lacks; none: it can be served."""
    return [f"{folder} lacks {x}" for x in REQUIRED if not exists(spark, f"{folder}/{x}")] if exists(spark, folder) else [f"{folder} does not exist"]


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _files(spark, source)
    if not fs.rename(at, _files(spark, target)[1]):
        raise OSError(f"{source} can't be moved to {target}")


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def promote(spark: SparkSession, source: str, target: str, reason: str = "", dry_run: bool = False) -> dict:
    """Copy a complete model to ``target`` with a record of it; what stood there becomes ``target.previous``.

    The copy is made beside the target and moved in at the end, so that a
    folder that is half copied is never served.
    """
    missing = faults(spark, source)
    if missing:
        raise FileNotFoundError("; ".join(missing))
    text = "\n".join(r.value for r in spark.read.text(f"{source}/metadata.json").collect())
    record = json.loads(text) | {"promoted": {"from": source, "reason": reason, "at": datetime.now(UTC).isoformat(timespec="seconds")}}
    if dry_run:
        return record
    staged = f"{target}.staged"
    _remove(spark, staged)
    (fs, a), (other, b) = _files(spark, source), _files(spark, staged)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, spark._jsc.hadoopConfiguration())
    out = other.create(_files(spark, f"{staged}/metadata.json")[1], True)
    out.write(bytearray(json.dumps(record, indent=2).encode()))
    out.close()
    if exists(spark, target):
        _remove(spark, f"{target}.previous")
        _move(spark, target, f"{target}.previous")
    _move(spark, staged, target)
    return record


def rollback(spark: SparkSession, target: str, dry_run: bool = False) -> None:
    """Serve the previous model again; the present one goes."""
    previous = f"{target}.previous"
    missing = faults(spark, previous)
    if missing:
        raise FileNotFoundError("; ".join(missing))
    if dry_run:
        return
    if exists(spark, target):
        _remove(spark, f"{target}.rolledback")
        _move(spark, target, f"{target}.rolledback")
    _move(spark, previous, target)
    _remove(spark, f"{target}.rolledback")
