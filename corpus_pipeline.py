"""A training-data pipeline over documents: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.langid import UNDETERMINED, identify
from corpusloom.llm.line_dedup import line_dedup
from corpusloom.llm.mixing import mix_documents
from corpusloom.llm.near_dedup import near_dedup
from corpusloom.llm.pieces import encode_documents
from corpusloom.sources.storage import materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SURE = 0.9  # score from which a prediction overrules the declared language
BROADCAST_IDS = 2_000_000  # 16 bytes each


def _model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter and texts that are surely in another language than declared.

    Null and empty texts go, a null lang is no declaration, null and repeated ids change nothing.
    Extra columns are dropped; an empty table stays one.
    """
    ship_package(spark)
    found = identify(docs, keep=COLUMNS[1:])
    other = F.coalesce((F.col("lang") != F.col("lang_pred")) & (F.col("score") >= SURE), F.lit(False))
    return found.where((F.col("lang_pred") != UNDETERMINED) & ~other).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines that stand elsewhere before; a document that is nothing else goes.

    Null texts and sources stay as they are; rows that repeat id and text are treated alike.  ``n_chars`` follows the text.
    Extra columns are dropped; an empty table stays one.
    """
    rows = line_dedup(docs.select(*COLUMNS))
    empty = (F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", length).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Texts without words and rows of null id stay.  Rows that repeat an id are told apart by their texts; rows that repeat both go
    or stay together.  Extra columns are dropped; an empty table stays one.
    """
    ship_package(spark)
    gone = near_dedup(docs, words=5, num=80, den=100).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    gone = materialize(gone.distinct(), "near-dropped")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash"))
    return docs.select(*COLUMNS).join(gone, same, "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask.

    A null source is a source, a null text has no size and is taken as its source's hash threshold says, null and
    repeated ids are taken one by one.  Extra columns are dropped; an empty table stays one.
    """
    return mix_documents(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as SentencePiece ids, each checked by decoding.

    Null and empty texts have no ids; nothing else is read.  Extra columns are dropped; an empty table stays one.
    """
    ship_package(spark)
    return encode_documents(docs.select(*COLUMNS), _model_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
