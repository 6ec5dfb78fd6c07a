"""Deterministic stratified samples and the scoring of annotations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.measures import ratio


def allocate(sizes: dict[str, int], total: int, least: int = 1) -> dict[str, int]:
    """Largest-remainder allocation of ``total`` to strata by size, each at least ``least`` and at most its own size.

    Strata are few (fields by periods), so this is arithmetic on their sizes.
    """
    everything = sum(sizes.values())
    if not everything:
        return dict.fromkeys(sizes, 0)
    total = min(total, everything)
    exact = {k: total * n / everything for k, n in sizes.items()}
    got = {k: min(sizes[k], max(min(least, sizes[k]), math.floor(exact[k]))) for k in sizes}
    order = sorted(sizes, key=lambda k: (-(exact[k] - math.floor(exact[k])), k))
    while sum(got.values()) < total:
        for k in order:
            if sum(got.values()) < total and got[k] < sizes[k]:
                got[k] += 1
    while sum(got.values()) > total:
        k = max((k for k in got if got[k] > least), key=lambda k: (got[k] - exact[k], k), default=None)
        if k is None:
            break
        got[k] -= 1
    return got


def hash_order(*columns: str) -> Column:
    """A fixed pseudo-random order: MD5 of the columns as text."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def stratified(df: DataFrame, strata: list[str], order: Column, n: int | Column) -> DataFrame:
    """The first n rows of each stratum in a fixed pseudo-random order; adds ``place``."""
    here = Window.partitionBy(*strata).orderBy(order)
    return df.withColumn("place", F.row_number().over(here)).where(F.col("place") <= n)


def split_labels(text: Column) -> Column:
    """The labels of a text joined by semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def set_scores(df: DataFrame, gold: str, predicted: str, by: list[str]) -> DataFrame:
    """Micro-averaged precision, recall and F1 of label sets, by group; null on a zero denominator."""
    hit = F.sum(F.size(F.array_intersect(gold, predicted)))
    extra = F.sum(F.size(F.array_except(predicted, gold)))
    missed = F.sum(F.size(F.array_except(gold, predicted)))
    return with_scores(df.groupBy(*by).agg(hit.alias("tp"), extra.alias("fp"), missed.alias("fn")))


def document_scores(df: DataFrame, gold: Column, predicted: Column, by: list[str]) -> DataFrame:
    """The confusion of a yes/no label by group, with its scores."""
    n = lambda c, name: F.count_if(c).alias(name)
    return with_scores(df.groupBy(*by).agg(n(gold & predicted, "tp"), n(~gold & predicted, "fp"), n(gold & ~predicted, "fn"), n(~gold & ~predicted, "tn")))


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and false_negative_rate to tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "false_negative_rate": ratio(fn, tp + fn)}
    )


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_filled): which annotation columns are filled in."""
    filled = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[filled(c).alias(c) for c in columns])
    return one.unpivot("n_rows", columns, "column", "n_filled").select("column", "n_rows", "n_filled")


# The distribution function of a Poisson count of mean 1 at 0, 1, 2, ..; beyond the last, less than one draw in a million.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


def poisson_draw(seed: int, *columns: str) -> Column:
    """How often a row is drawn: a Poisson count of mean 1 from the MD5 of the columns, the same on every run and in SQL."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    uniform = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum((F.when(uniform >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def bootstrap_scores(df: DataFrame, key: str, gold: Column, predicted: Column, by: list[str], replicates: int = 1000, seed: int = 20250801) -> DataFrame:
    """Intervals of precision, recall and F1 of a yes/no label over redraws of the annotated rows: (by, metric, low, high, n_defined).

    Rows are drawn by Poisson counts, which needs no gathering: a replicate is one more grouping column.  Annotated samples have
    hundreds or thousands of rows.  Replicates in which a score has no denominator are left out of its interval.
    """
    drawn = df.select(*by, key, gold.alias("g"), predicted.alias("p")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("w", poisson_draw(seed, key, "b")).where("w > 0")
    n = lambda c, name: F.sum(F.when(c, F.col("w")).otherwise(0)).alias(name)
    counts = drawn.groupBy(*by, "b").agg(n(F.col("g") & F.col("p"), "tp"), n(~F.col("g") & F.col("p"), "fp"), n(F.col("g") & ~F.col("p"), "fn"))
    long = with_scores(counts).unpivot([*by, "b"], ["precision", "recall", "f1"], "metric", "value").where("value is not null")
    q = lambda p: F.percentile("value", F.lit(p))
    return long.groupBy(*by, "metric").agg(q(0.025).alias("low"), q(0.975).alias("high"), F.count(F.lit(1)).alias("n_defined"))
