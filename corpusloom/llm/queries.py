"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import ann, exact_dedup, html_extract, langid, line_dedup, mixing, near_dedup, pieces, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """The place of a public vocabulary file; only the path enters the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_files.token_table(docs, _vocabulary("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.transactions(_table(spark, sf_dir, "pages"), with_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.encode_documents(docs, _vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "ids_crc32", "round_trip", "n_differing")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_nearest": op5_nearest,
    "op6_line_dedup": op6_line_dedup,
    "op7_main_text": op7_main_text,
    "op8_pieces": op8_pieces,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
