"""Exact deduplication through content-defined chunk recipes (DataFrame functions only).

A text is normalised by deleting white space and cut at content-defined points: after a
sentence end once ``min_chunk`` characters have gone by, and at ``max_chunk`` in any case.  An
insertion therefore only disturbs the chunks around it.  Each distinct chunk content is moved once,
into a map-side combined aggregation that *verifies* its hash as an identifier: no hash may have two
contents.  From then on a document is its ordered list of identifiers, its
recipe, and only recipes are compared and moved.  If a hash turns out to stand for two contents,
the whole recipe build escalates to SHA-256 identifiers, verified in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.storage import materialize

WHITE = " \t\n\x0b\f\r"
MIN_CHUNK, MAX_CHUNK = 512, 4096


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def chunks(norm: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """Content-defined chunks in order; their concatenation is ``norm``."""
    cut = "[.!?;:\\u3002\\uff01\\uff1f]"
    pattern = f"(?s).{{{min_chunk}}}.{{0,{max_chunk - min_chunk - 1}}}?{cut}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _quick(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _strong(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def ambiguous(pieces: DataFrame, identify) -> DataFrame:
    """The identifiers in ``pieces`` (chunk) that stand for more than one content.

    Each distinct content moves once, as the key of an aggregation that is combined before the shuffle.
    """
    contents = pieces.groupBy(identify(F.col("chunk")).alias("chunk_id"), "chunk").agg(F.lit(1).alias("one"))
    return contents.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers=(_quick, _strong), **sizes: int
) -> DataFrame:
    """(doc_id, n_code_points, text_sha256, recipe) with verified chunk identifiers.

    ``identifiers`` are tried in turn; the first whose every identifier has one content is used.  Texts are normalised and cut once:
    their chunks are written with the first recipes.
    """
    norm = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.char_length(text_col), F.lit(0)).alias("n_code_points"),
        normalised(F.col(text_col)).alias("norm"),
    )
    cut = norm.select("doc_id", "n_code_points", F.sha2(F.col("norm"), 256).alias("text_sha256"), chunks(F.col("norm"), **sizes).alias("chunks"))
    first, *others = identifiers
    rows = materialize(cut.withColumn("recipe", F.transform("chunks", first)), "op9-chunks")
    pieces = rows.select(F.explode("chunks").alias("chunk"))
    if ambiguous(pieces, first).isEmpty():
        return rows.drop("chunks")
    for identify in others:
        if ambiguous(pieces, identify).isEmpty():
            return rows.select("doc_id", "n_code_points", "text_sha256", F.transform("chunks", identify).alias("recipe"))
    raise ValueError("every identifier function gave one identifier to two contents")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Groups of documents whose texts are identical after deleting white space.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256.  Of a group, the row with the
    most code points in the original text stays, then the smallest doc_id (null ids last).  A null text is
    an empty one; all empty texts form one group.  Repeated rows count towards group_size, and
    rows that repeat the keeper in id and length are kept with it.  Other columns are not read.
    An empty table gives an empty result.

    A group's rows never meet in one task: the keeper comes from a partial aggregation over recipes, and the
    members join the one row of their group, a join whose hot keys adaptive execution can split.
    """
    rows = materialize(
        recipes(docs, id_col, text_col, **options).withColumn(
            "recipe_hash", F.xxhash64("recipe", F.size("recipe"))
        ),
        "op9-recipes",
    )
    groups = materialize(
        rows.groupBy("recipe_hash", "recipe")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("id"))).alias("best"),
        )
        .select(
            "recipe_hash",
            "recipe",
            "group_size",
            F.col("best.id").alias("keep_id"),
            (-F.col("best.col1")).alias("keep_points"),
        ),
        "op9-groups",
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("keep_points"))
    return rows.join(groups, ["recipe_hash", "recipe"]).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
