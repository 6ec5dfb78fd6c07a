"""Cross-site boilerplate lines by distinct-site spread (HyperLogLog, with exact counts near the threshold).

Each line that isn't blank becomes a 128-bit hash.  Sketches of the sites it stands on merge by aggregation; where the estimate lies
so near the threshold that the sketch can't decide, the line's sites are counted exactly.  A line on
``min_sites`` or more sites is boilerplate and stays only where it stands first; lines of few words, which meet by chance, must stand
on ``short_sites``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.storage import materialize

WHITE = " \t\x0b\f\r"
MIN_SITES, SHORT_SITES = 5, 10
MIN_WORDS = 5  # below, a line is short
SKETCH_BITS = 9
DEVIATIONS = 5.0
BROADCAST_LINES = 500_000  # 24 bytes each
BROADCAST_POSITIONS = 2_000_000  # 4 bytes each and 32 a document


def line_key(line: Column) -> list[Column]:
    """Two independent 64-bit hashes of a trimmed line."""
    trimmed = F.trim(line, F.lit(WHITE))
    return [F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2")]


def lines_of(docs: DataFrame, id_col: str, site_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, text_hash, site, pos, h1, h2, long) of lines that have a word; ``long`` says that they have ``min_words``."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"),
    )
    words = F.regexp_count("line", F.lit("[^\\x20\\x09-\\x0D]+"))
    return rows.where(words > 0).select("doc_id", "text_hash", "site", "pos", *line_key(F.col("line")), (words >= min_words).alias("long"))


def spread_lines(lines: DataFrame, min_sites: int, short_sites: int) -> DataFrame:
    """(h1, h2, first_doc) of lines on enough distinct sites; a null site counts as none."""
    error = DEVIATIONS * 1.04 / 2 ** (SKETCH_BITS / 2)
    need = F.when(F.col("long"), min_sites).otherwise(short_sites)
    sketched = materialize(
        lines.groupBy("h1", "h2", "long")
        .agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min("doc_id").alias("first_doc"))
        .select("h1", "h2", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"), need.alias("need"))
        .where(F.col("sites") >= F.col("need") * (1 - error) - 1),
        "op6-sketched",
    )
    sure = F.col("sites") > F.col("need") * (1 + error) + 1
    near = sketched.where(~sure).select("h1", "h2", "first_doc", "need")
    if near.count() <= BROADCAST_LINES:
        near = F.broadcast(near)
    exact = lines.join(near, ["h1", "h2"]).groupBy("h1", "h2", "first_doc", "need", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h1", "h2", "first_doc", "need").agg(F.count("site").alias("sites")).where(F.col("sites") >= F.col("need"))
    return sketched.where(sure).select("h1", "h2", "first_doc").unionByName(exact.select("h1", "h2", "first_doc"))


def line_dedup(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    short_sites: int = SHORT_SITES,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    site_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The documents without the boilerplate lines that stand elsewhere before: all columns, then n_lines and n_removed.

    A line is boilerplate if it stands, trimmed, on at least ``min_sites`` distinct sites, or ``short_sites`` if it has fewer than
    ``min_words`` words.  Blank lines aren't.  It stays once, at its first place in the document of smallest id, and goes everywhere else; other
    lines stay as they are.  Null texts stay null with 0 lines; a null site counts as no site; documents of null id never
    hold a line's first place unless no other does.  Rows that repeat id and text are treated alike.
    An input column named n_lines or n_removed is replaced.  An empty table gives an empty result.
    """
    lines = materialize(lines_of(docs, id_col, site_col, text_col, min_words), "op6-lines")
    spread = materialize(spread_lines(lines, min_sites, short_sites), "op6-spread")
    if spread.count() <= BROADCAST_LINES:
        spread = F.broadcast(spread)
    first = F.col("doc_id").eqNullSafe(F.col("first_doc"))
    places = F.array_sort(F.collect_set("pos"))
    removed = (
        lines.join(spread, ["h1", "h2"])
        .repartition("doc_id", "text_hash")
        .groupBy("doc_id", "text_hash", "h1", "h2", first.alias("first"))
        .agg(places.alias("places"))
        .withColumn("places", F.when(F.col("first"), F.slice("places", 2, 1 << 30)).otherwise(F.col("places")))
        .groupBy("doc_id", "text_hash")
        .agg(F.flatten(F.collect_list("places")).alias("removed"))
        .where(F.size("removed") > 0)
        .select(F.col("doc_id").alias("removed_id"), F.col("text_hash").alias("removed_hash"), "removed")
    )
    removed = materialize(removed, "op6-removed")
    volume = removed.agg(F.coalesce(F.sum(F.size("removed") + 8), F.lit(0))).first()[0]
    if volume <= BROADCAST_POSITIONS:
        removed = F.broadcast(removed)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(*columns).withColumns({"_op6_lines": F.split(F.col(text_col), "\n", -1), "_op6_hash": F.xxhash64(text_col)})
    same = F.col(id_col).eqNullSafe(F.col("removed_id")) & (F.col("_op6_hash") == F.col("removed_hash"))
    # Set difference by hash: linear in the lines, however many are removed.
    places = F.array_except(F.sequence(F.lit(0), F.size("_op6_lines") - 1), F.col("removed"))
    kept = F.transform(places, lambda i: F.get("_op6_lines", i))
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    joined = own.join(removed, same, "left")
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in columns],
        F.coalesce(F.size("_op6_lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l),
s AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE words > 0 GROUP BY key
  HAVING count(DISTINCT source) >= CASE WHEN min(words) >= 5 THEN 5 ELSE 10 END),
j AS (
  SELECT k.*, s.first_doc, row_number() OVER (PARTITION BY k.doc_id, k.key, k.words ORDER BY pos) AS nth
  FROM k LEFT JOIN s ON k.key = s.key AND k.words > 0),
r AS (
  SELECT doc_id, pos, line, first_doc IS NOT NULL AND NOT (doc_id = first_doc AND nth = 1) AS gone FROM j),
g AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text,
         count(*)::INT AS n_lines, count_if(gone)::INT AS n_removed
  FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text,
       coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
