"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.common import table


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer's vocabulary file: in ``folder``, or where the installed package has it."""
    import public_tokenizers

    return f"{folder}/{name}" if folder else str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.toxicity import detect

    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.media import media_features, store_column

    return media_features(store_column(table(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_rans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.binary_output import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.vector_codes import encode

    return encode(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.fill_in_middle import digests

    return digests(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from aspectra.llm.quality import measured

    return measured(table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_bpe, op4_minhash, op5_pivot_index, op6_packing, op7_language, op8_matroska, op9_rans_output, op10_secrets, op11_vector_codes, op12_fill_in_middle, op13_quality)}


def oracle_sql() -> dict[str, str]:
    from aspectra.llm import fill_in_middle, quality_sql, secrets_sql, vector_codes

    return {"op10_secrets": secrets_sql.twin(), "op11_vector_codes": vector_codes.twin(), "op12_fill_in_middle": fill_in_middle.twin(), "op13_quality": quality_sql.twin()}
