"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Targets share a token budget between sources.  A target above its source's size is met by whole
passes plus a part of one further pass; that part is the documents whose hash lies below a threshold.
The threshold comes from nested histograms: tokens are summed by source and the leading byte of the
hash, the bucket in which the running sum crosses the budget is found, and only that bucket is
refined by the next byte, until it holds one document.  Documents are then filtered by comparing
their hash with the threshold; nothing is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.storage import materialize

LEVELS, BITS = 7, 8  # 56 bits of hash, one byte a level
PLACE_BITS = 16  # the last of them tell identical rows apart
BROADCAST_ROWS = 10_000  # one plan row a source, under 200 bytes each
MAX_PASSES = 3


def n_words(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """56 bits: 40 of MD5 of the id and the text's MD5, uniform and the same on every run, then 16 of the row's place in the input.

    The place decides only between rows of one id and text, which are the same whichever is taken.
    """
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(" "), F.md5(F.coalesce(text, F.lit(""))))
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS)
    return F.conv(F.substring(F.md5(key), 1, (LEVELS * BITS - PLACE_BITS) // 4), 16, 10).cast("long") * (1 << PLACE_BITS) + place


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only where the counted rows prove it small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds to each row, under the names in ``sums``, what these columns add up to over all rows before it.

    No task gathers all rows: they are dealt out by range, and what a range's rows sum up to is added to the running sums of
    the ranges after it.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = dealt.groupBy("part").agg(*[F.sum(c).alias(f"part_{n}") for n, c in sums.items()])
    parts = parts.select("part", *[F.coalesce(F.sum(f"part_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums])
    within = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = within.join(parts, "part")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"before_{n}")).alias(n) for n in sums])


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target): water-filling of the sum of sizes under caps of ``passes`` x size.

    Sources by rising cap per weight are capped from the first on; the level per unit of weight is that of the first source which
    stays below its cap.
    """
    by_name = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "op10-ranked")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = materialize(by_name.select("source", "source_size", weight.alias("weight"), (passes * F.col("source_size")).alias("cap")), "op10-sources")
    total, weight_sum = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    order = [(F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filled = running(weighed, order, {"capped": F.col("cap"), "weight_before": F.col("weight")}, "op10-caps")
    level = (F.lit(total) - F.col("capped")).cast("double") / (F.lit(weight_sum) - F.col("weight_before"))
    first = filled.select("capped", level.alias("level"), "weight", "cap").where(F.col("level") * F.col("weight") <= F.col("cap"))
    found = first.agg(F.min_by("level", F.struct("capped", -F.col("level"))).alias("level")).first()["level"]
    return weighed.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(found or 0.0) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """(source, shift, prefix, whole): take a document where hash >> shift is below prefix, or equals it if whole."""
    level = plan.select(
        "source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"), F.lit(LEVELS * BITS).alias("shift")
    )
    done: list[DataFrame] = []
    words = sized.where(F.col("size") > 0).select(F.col("source").alias("s"), "hash", "size")
    for k in range(LEVELS):
        shift = (LEVELS - 1 - k) * BITS
        inside = words.join(
            _small(level, n_sources),
            F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")),
        )
        histogram = inside.groupBy("source", "rest", "base", F.shiftright("hash", shift).alias("prefix")).agg(
            F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs")
        )
        running = Window.partitionBy("source").orderBy("prefix")  # at most 2**BITS rows a source
        crossing = materialize(
            histogram.withColumn("upto", F.col("base") + F.sum("tokens").over(running))
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest")))
            .select(
                "source",
                "rest",
                "prefix",
                (F.col("upto") - F.col("tokens")).alias("base"),
                F.lit(shift).alias("shift"),
                "tokens",
                "docs",
            ),
            f"op10-level{k}",
        )
        fine = F.col("docs") <= 1 if k < LEVELS - 1 else F.lit(True)
        done.append(crossing.where(fine))
        level = crossing.where(~fine).select("source", "rest", "prefix", "base", "shift")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).select(
        "source", "shift", "prefix", (F.col("rest") - F.col("base") > F.col("tokens") / 2).alias("whole")
    )


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source, size, hash) in the shared folder: the texts are read once."""
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")]
    return materialize(docs.select(*columns, row_hash(F.col(id_col), F.col(text_col)).alias("hash")), "op10-sized")


def mixing_plan(sized: DataFrame, weights: tuple[int, ...], passes: int) -> tuple[DataFrame, int]:
    """One row a source: mix_source, source_size, target, whole passes and the threshold of the part; and their number."""
    shares = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes), "op10-targets")
    n_sources = shares.count()
    full = F.when(F.col("source_size") > 0, F.least(F.lit(passes), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    plan = shares.withColumn("full", full.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    part = thresholds(sized, plan.where((F.col("rest") > 0) & (F.col("full") < passes)), n_sources)
    plan = plan.join(part.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.select(F.col("source").alias("mix_source"), "source_size", "target", "full", "shift", "prefix", "whole")
    return materialize(plan, "op10-plan"), n_sources


def _copies(doc_hash: Column) -> Column:
    """How often a document of the joined plan row is taken."""
    place = F.when(F.col("shift") == LEVELS * BITS, F.lit(0).cast("long"))
    for k in range(LEVELS):
        place = place.when(F.col("shift") == k * BITS, F.shiftright(doc_hash, k * BITS))
    extra = F.coalesce((place < F.col("prefix")) | (F.col("whole") & (place == F.col("prefix"))), F.lit(False))
    return F.col("full") + extra.cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES
) -> DataFrame:
    """How often each document is taken so that sources meet their share of the sum of all sizes.

    One row per input row: doc_id, size (words), source_size, target (the source's), taken (words, repeats counted),
    copies.  A source is taken in whole passes and then a part of a pass, chosen by hash, that ends within half a
    document of the target.  A null text has size 0; documents of null source form a source of their own, ranked
    last.  Rows that repeat an id are taken by their texts, and identical rows one by one.  Sources without words, and empty
    tables, have target 0.  Other columns are not read.
    """
    sized = _sized(docs, id_col, source_col, text_col)
    plan, n_sources = mixing_plan(sized, weights, passes)
    joined = sized.join(_small(plan, n_sources), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("copies", _copies(F.col("hash")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES
) -> DataFrame:
    """The mix itself: each document with all its columns, as often as ``mix_sources`` takes it.

    The plan is one small row a source, so the texts aren't shuffled.
    """
    # All columns are written with size and hash, so that a row keeps its hash; input columns pass through a struct, so that none can
    # clash with the plan's.
    whole = F.struct(*docs.columns).alias("row")
    columns = [F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("hash")]
    rows = materialize(docs.select(whole, *columns), "op10-rows")
    plan, n_sources = mixing_plan(rows.select("source", "size", "hash"), weights, passes)
    joined = rows.join(_small(plan, n_sources), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("copies", _copies(F.col("hash")))
    repeated = joined.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || md5(coalesce(text, ''))), 1, 10))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k
  FROM s),
c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight
  FROM o),
l AS (
  SELECT min_by((total - capped)::DOUBLE / open_weight, k) AS lvl FROM c
  WHERE (total - capped)::DOUBLE / open_weight * w <= 3 * source_size),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(lvl, 0) * w) AS target FROM s, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS f FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.f, p.target - p.f * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS at_hash
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * c)::BIGINT AS taken, c AS copies
FROM (SELECT *, (f + CASE WHEN f >= 3 OR rest <= 0 THEN 0 WHEN upto <= rest THEN 1
                          WHEN upto - at_hash <= rest AND rest - (upto - at_hash) > at_hash / 2 THEN 1 ELSE 0 END)::BIGINT AS c
      FROM r)
"""
