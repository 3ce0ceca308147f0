"""Sinks: split files, reports, the resumable fact table, the row store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.sources.readers import exists


def write_splits(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One folder for each split."""
    writer = df.write.mode("overwrite").partitionBy("split")
    (writer.option("header", True).option("escape", '"').csv if kind == "csv" else writer.parquet)(path)


def write_columns(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small frame as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def completed_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys with a completion mark; a key without rows can be complete too."""
    if not exists(spark, f"{path}/done"):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.parquet(f"{path}/done").select(key).distinct()


def append_pending(work: DataFrame, path: str, key: str, score: Callable[[DataFrame], DataFrame], restart: bool = False) -> int:
    """Score the keys that are not complete, append their rows, then mark them. Returns the number of keys.

    Rows are written under their key by dynamic overwrite: a run that broke off
    between rows and marks leaves no double rows behind.
    """
    spark = work.sparkSession
    if restart:
        for part in ("rows", "done"):
            found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    pending = work.join(completed_keys(spark, path, key), key, "left_anti")
    keys = pending.select(key).distinct()
    n = keys.count()
    if n:
        score(pending).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/rows")
        keys.write.mode("append").parquet(f"{path}/done")
    return n


class ReviewStore:
    """Submitted reviews: append with ids, the latest of a key, and counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        from aspectra.sources.schemas import STORED

        return self.spark.read.schema(STORED).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], STORED)

    def add(self, new: DataFrame) -> None:
        """new: (model_key, text, rating, analysis). Ids follow the largest so far, in the order of the texts."""
        from aspectra.operators.catalog import enumerate_rows

        last = self.rows().agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
        numbered = enumerate_rows(new.withColumn("_o", F.struct("model_key", "text")), "_o", "n").crossJoin(F.broadcast(last))
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        numbered.select((F.col("last") + F.col("n")).alias("id"), "model_key", "text", F.col("rating").cast("int").alias("rating"), "analysis", now.alias("created_utc")).write.mode("append").parquet(self.path)

    def latest(self, key: str, limit: int = 20) -> DataFrame:
        return self.rows().where(F.col("model_key") == key).orderBy(F.desc("id")).limit(limit)

    def count(self) -> int:
        return self.rows().count()
