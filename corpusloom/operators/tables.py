"""Relational building blocks: keep-first, membership, coverage, ranks and windows of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.measures import ratio


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first in a total order, with all its columns; rows with a null key go."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    here = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(here)).where("_place = 1").drop("_place")


def latest_nonempty(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row a key; each field has its last value that isn't null or empty."""
    pick = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order)))
    return df.groupBy(key).agg(*[pick(c).alias(c) for c in fields])


def member_flag(df: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """All rows, with whether their key is among the others'."""
    present = others.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(present, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number: empty where the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_total(df: DataFrame, value: Column, by: list[str], name: str) -> DataFrame:
    """The sum of a value over the rows of equal ``by`` columns, on each of them."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank."""
    here = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(here)).where(F.col(rank) <= k)


def average_rank_share(value: Column, by: list[str]) -> Column:
    """The percentile rank in which ties get their average rank."""
    group = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return (F.rank().over(group.orderBy(value)) + (ties - 1) / 2) / F.count(value).over(group)


def year_windows(first: int, last: int, fixed: list[tuple[int, int]], width: int) -> list[tuple[str, int, int]]:
    """(label, start, end): the whole range, fixed windows, and every rolling window of ``width`` years."""
    named = [("full", first, last), *((f"{a}-{b}", a, b) for a, b in fixed)]
    rolling = [(f"{a}-{a + width - 1}", a, a + width - 1) for a in range(first, last - width + 2)]
    return list(dict.fromkeys(named + rolling))


def in_windows(df: DataFrame, windows: list[tuple[str, int, int]], year: str = "year") -> DataFrame:
    """Each row once for every window that holds its year: one scan serves all windows.

    The windows travel inside the plan as an array of structs, so no join and no shuffle takes place.
    """
    of = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(a).alias("start"), F.lit(b).alias("end")) for w, a, b in windows])
    fit = F.filter(of, lambda w: F.col(year).between(w["start"], w["end"]))
    return df.withColumn("_w", F.explode(fit)).withColumn("window", F.col("_w.window")).drop("_w")


def coverage(df: DataFrame, by: list[str], present: Column) -> DataFrame:
    """Rows, rows where something is present, and their share, by group."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(present).alias("n_present"))
    return counted.withColumn("share", ratio(F.col("n_present"), F.col("n_rows")))


def cube_counts(df: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates over every combination of the grouping columns; ``all`` where one isn't grouped by."""
    grouped = df.cube(*by).agg(*aggregates, *[F.grouping(c).alias(f"_g_{c}") for c in by])
    return grouped.select(
        *[F.when(F.col(f"_g_{c}") == 1, "all").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("missing"))).alias(c) for c in by],
        *[c for c in grouped.columns if c not in by and not c.startswith("_g_")],
    )


MAX_KEYS = 10_000


def dense_grid(df: DataFrame, rows: list[str], columns: list[str], values: list[str]) -> DataFrame:
    """Every pair of an occurring row key and an occurring column key; values that aren't there are 0.

    Up to ``MAX_KEYS`` column keys (such as years and fields), which are few by nature, go as one array to each row; beyond that the row keys
    are dealt out for a plain cross join, since every pair is the result.
    """
    columns_ = df.select(*columns).distinct()
    if columns_.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        keys = columns_.agg(F.collect_set(F.struct(*columns)).alias("all"))
        grid = df.select(*rows).distinct().crossJoin(F.broadcast(keys)).withColumn("c", F.explode("all")).select(*rows, "c.*")
    else:
        grid = df.select(*rows).distinct().crossJoin(columns_)
    joined = grid.join(df, [*rows, *columns], "left")
    return joined.select(*rows, *columns, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
