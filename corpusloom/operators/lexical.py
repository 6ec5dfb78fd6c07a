"""Terms of two fields: tokens, document frequencies, TF-IDF salience, keyness, and trends.

Everything is in long form, (doc, term) rows; no document-term matrix is built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.measures import ratio
from corpusloom.sources.storage import materialize

TOKEN = "[a-z]{2,}"


def tokens(text: Column, pattern: str = TOKEN, stopwords: tuple[str, ...] = ()) -> Column:
    """The lower-cased matches of a pattern in order, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    if not stopwords:
        return found
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(found, lambda t: ~F.array_contains(stop, t))


def bigrams(words: Column) -> Column:
    """Neighbouring tokens joined by a space; stop words left before, so that pairs span the gaps."""
    pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair)).otherwise(F.array().cast("array<string>"))


def term_counts(docs: DataFrame, terms: Column, keep: list[str]) -> DataFrame:
    """(doc_id, keep, term, tf)."""
    rows = docs.select("doc_id", *keep, F.explode(terms).alias("term"))
    return rows.groupBy("doc_id", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def gated(counts: DataFrame, n_docs: int, min_df: int, max_share: float) -> DataFrame:
    """Only terms in at least ``min_df`` documents and at most a share of all; the counts are written once and read twice."""
    counts = materialize(counts, "term-counts")
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.join(df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs)), "term")


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``weight``: tf times ln((1 + N) / (1 + df)) + 1, scaled to unit length per document."""
    raw = counts.withColumn("raw", F.col("tf") * (F.ln((F.lit(1.0) + n_docs) / (1.0 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id"))))


def salience(weighted: DataFrame, sizes: DataFrame, group: str, k: int = 25) -> DataFrame:
    """(group, rank, term, mean_in, mean_out, salience): terms whose mean weight in a group exceeds that outside it.

    ``sizes`` has a row a group: (group, n), all its documents counted, those without a term too.
    """
    total = sizes.agg(F.sum("n").alias("n_all"))
    inside = weighted.groupBy(group, "term").agg(F.sum("weight").alias("sum_in"))
    inside = inside.withColumn("sum_all", F.sum("sum_in").over(Window.partitionBy("term")))  # a row a group
    joined = inside.join(F.broadcast(sizes), group).crossJoin(F.broadcast(total))  # a row a group; one row
    out = (F.col("sum_all") - F.col("sum_in")) / F.greatest(F.col("n_all") - F.col("n"), F.lit(1))
    scored = joined.select(group, "term", ratio(F.col("sum_in"), F.col("n")).alias("mean_in"), out.alias("mean_out"))
    scored = scored.withColumn("salience", F.col("mean_in") - F.col("mean_out")).where("salience > 0")
    order = Window.partitionBy(group).orderBy(F.desc(F.round("salience", 12)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyness(counts: DataFrame, sizes: dict[str, int], group: str, fields: tuple[str, str]) -> DataFrame:
    """Per term: document frequencies, smoothed shares, base-2 log odds of each field against the other, salience."""
    side = lambda f: F.count_if(F.col(group) == f)
    by = counts.where(F.col(group).isin(*fields)).groupBy("term").agg(side(fields[0]).alias("df_a"), side(fields[1]).alias("df_b"))
    p = lambda c, f: (F.col(c) + 0.5) / F.lit(sizes.get(f, 0) + 1.0)
    both = by.withColumns({"p_a": p("df_a", fields[0]), "p_b": p("df_b", fields[1])})
    odds = F.log2((F.col("p_a") / (1 - F.col("p_a"))) / (F.col("p_b") / (1 - F.col("p_b"))))
    return both.withColumns({"total_df": F.col("df_a") + F.col("df_b"), "log_odds_a": odds, "log_odds_b": -odds}).withColumn(
        "salience", F.abs("log_odds_a") * F.log1p("total_df")
    )


def loess_ends(x: np.ndarray, y: np.ndarray, span: float = 0.75) -> tuple[float, float]:
    """Local linear fits with tricube weights at the first and last x; nan where a fit isn't determined."""
    if len(x) < 2:
        return float("nan"), float("nan")
    k = max(2, int(np.floor(span * len(x) + 1e-9)))

    def at(x0: float) -> float:
        d = np.abs(x - x0)
        reach = np.sort(d)[k - 1] * (max(span, 1.0))
        w = np.where(d < reach, (1 - (d / reach) ** 3) ** 3, 0.0) if reach > 0 else (d == 0).astype(float)
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        spread = np.sum(w * (x - mx) ** 2)
        return float(my + (np.sum(w * (x - mx) * (y - my)) / spread * (x0 - mx) if spread > 1e-12 else 0.0))

    return at(x[0]), at(x[-1])


def trends(yearly: DataFrame, by: list[str], value: str, least_positive: int = 4) -> DataFrame:
    """(by, start, end, growth): LOESS ends of each series, null with fewer than ``least_positive`` positive years.

    A series is one row a year, so a group is small.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("year")
        x, y = frame["year"].to_numpy(float), frame[value].to_numpy(float)
        start, end = loess_ends(x, y) if (y > 0).sum() >= least_positive else (None, None)
        growth = float(np.log(end / start)) if start is not None and start > 0 and end > 0 else None
        return pd.DataFrame([[*key, start, end, growth]], columns=[*by, "start", "end", "growth"])

    kinds = ", ".join(f"{c} {yearly.schema[c].dataType.simpleString()}" for c in by)
    return yearly.groupBy(*by).applyInPandas(run, f"{kinds}, start double, end double, growth double")


def chosen_trends(trend: DataFrame, totals: DataFrame, field: str, least: int = 40, level: float = 0.005, growth: float = 0.3, k: int = 5) -> DataFrame:
    """The k fastest rising and falling terms of each field among the frequent ones: adds direction and rank."""
    known = trend.join(totals, [field, "term"]).where(
        (F.col("n") >= least) & (F.greatest("start", "end") >= level) & (F.abs("growth") >= growth)
    )
    known = known.withColumn("direction", F.when(F.col("growth") > 0, "rising").otherwise("declining"))
    order = Window.partitionBy(field, "direction").orderBy(F.desc(F.abs("growth")), "term")
    return known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
