"""How two fields differ in the families they mention, year by year, and how sure that is.

Mentions are rows (key, year, field, family), a paper's family once.  Counts become shares, shares become distances, all in long
form: no table is as wide as there are families.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.measures import jensen_shannon_term, ratio
from corpusloom.operators.tables import top_k


def top_families(mentions: DataFrame, k: int, fields: tuple[str, str]) -> DataFrame:
    """The union of each field's k most mentioned families; ties go to the smaller name."""
    counts = mentions.where(F.col("field").isin(*fields)).groupBy("field", "family").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["field"], [F.desc("n"), "family"], k).select("family").distinct()


def paper_weights(mentions: DataFrame) -> DataFrame:
    """Each paper weighs one, spread over its families."""
    rows = mentions.select("key", "year", "field", "family").distinct()
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("key")))


def field_shares(mentions: DataFrame, fields: tuple[str, str], by: list[str], weight: Column | None = None, pseudocount: float = 0.0) -> DataFrame:
    """(by, family, a, b, p, q): counts or weights of the two fields and their shares; families that neither has are absent."""
    w = F.lit(1.0) if weight is None else weight
    side = lambda f: F.sum(F.when(F.col("field") == f, w).otherwise(0.0))
    counts = mentions.where(F.col("field").isin(*fields)).groupBy(*by, "family").agg(side(fields[0]).alias("a"), side(fields[1]).alias("b"))
    group = Window.partitionBy(*by)
    share = lambda c: F.coalesce(F.try_divide(F.col(c) + pseudocount, F.sum(F.col(c) + pseudocount).over(group)), F.lit(0.0))
    return counts.withColumns({"p": share("a"), "q": share("b")})


def distances(shares: DataFrame, by: list[str]) -> DataFrame:
    """Jensen-Shannon divergence, total variation and cosine distance; null where a field has nothing."""
    p, q, a, b = F.col("p"), F.col("q"), F.col("a"), F.col("b")
    dot = F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b)))
    both = (F.sum(a) > 0) & (F.sum(b) > 0)
    return shares.groupBy(*by).agg(
        F.sum(a).alias("total_a"), F.sum(b).alias("total_b"),
        F.when(both, F.sum(jensen_shannon_term(p, q))).alias("jsd"),
        F.when(both, F.sum(F.abs(p - q)) / 2).alias("tv"),
        F.when(both, 1 - F.coalesce(dot, F.lit(0.0))).alias("cosine"),
    )


def contrast(yearly: DataFrame, value: str, early: tuple[int, int], late: tuple[int, int], by: list[str] | None = None) -> DataFrame:
    """Mean of the yearly values in two windows of years, and late minus early."""
    mean = lambda w: F.avg(F.when(F.col("year").between(*w), F.col(value)))
    out = yearly.groupBy(*(by or [])).agg(mean(early).alias("early"), mean(late).alias("late"))
    return out.withColumn("difference", F.col("late") - F.col("early"))


def selection_sensitivity(mentions: DataFrame, fields: tuple[str, str], ks: list[int]) -> DataFrame:
    """Yearly distances for every choice of k in one plan: a family's best rank says from which k on it takes part."""
    counts = mentions.where(F.col("field").isin(*fields)).groupBy("field", "family").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), "family")
    best = counts.withColumn("rank", F.row_number().over(order)).groupBy("family").agg(F.min("rank").alias("rank"))
    chosen = best.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank")))).select("family", "k")
    picked = mentions.join(chosen, "family")
    return distances(field_shares(picked, fields, ["k", "year"]), ["k", "year"])


def log_ratios(mentions: DataFrame, fields: tuple[str, str], least: int = 20) -> DataFrame:
    """Yearly base-2 log ratio of smoothed shares (second field over first), kept where both together reach ``least``."""
    years = mentions.select("year").distinct()
    families = mentions.select("family").distinct()
    counts = field_shares(mentions, fields, ["year"]).select("year", "family", "a", "b")
    grid = families.crossJoin(F.broadcast(years)).join(counts, ["year", "family"], "left").fillna(0.0, ["a", "b"])  # years are few
    group = Window.partitionBy("year")
    share = lambda c: (F.col(c) + 0.5) / F.sum(F.col(c) + 0.5).over(group)
    value = F.log2(share("b")) - F.log2(share("a"))
    return grid.withColumn("log_ratio", value).select("year", "family", "a", "b", "log_ratio", (F.col("a") + F.col("b") >= least).alias("supported"))


def suppress_generic(mentions: DataFrame, generic: str) -> DataFrame:
    """Without the generic family on papers that also name a specific one."""
    specific = mentions.where(F.col("family") != generic).select("key").distinct().withColumn("family", F.lit(generic))
    return mentions.join(specific, ["key", "family"], "left_anti")


def relabel(mentions: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Families renamed by a table; what then is the same on a paper counts once."""
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return mentions.withColumn("family", F.coalesce(F.try_element_at(table, F.col("family")), F.col("family"))).distinct()


# --- resampling: a paper is the unit; the frame of one year is what one task holds ---


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences of rows of counts; nan where a row is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = a / a.sum(-1, keepdims=True), b / b.sum(-1, keepdims=True)
        m = (p + q) / 2
        part = lambda x: np.where(x > 0, 0.5 * x * np.log2(x / m), 0.0).sum(-1)
        return np.where((a.sum(-1) > 0) & (b.sum(-1) > 0), part(p) + part(q), np.nan)


def paper_patterns(mentions: DataFrame) -> DataFrame:
    """(year, field, families, n): how many papers of a field and year name exactly this set of families.

    Papers of one pattern are alike to a bootstrap, so that a year of any number of papers becomes its patterns' counts.
    """
    sets = mentions.groupBy("key", "year", "field").agg(F.array_sort(F.collect_set("family")).alias("families"))
    return sets.groupBy("year", "field", "families").agg(F.count(F.lit(1)).alias("n"))


REPLICATES_A_TASK = 250


def _matrix(frame: pd.DataFrame, families: list[str]) -> np.ndarray:
    place = {f: i for i, f in enumerate(families)}
    out = np.zeros((len(frame), len(families)))
    for row, names in enumerate(frame["families"]):
        out[row, [place[n] for n in names]] = 1
    return out


def _sides(frame: pd.DataFrame, fields: tuple[str, str]) -> tuple[pd.DataFrame, pd.DataFrame, list[str]]:
    frame = frame.assign(order=frame["families"].map(lambda x: "\x00".join(x))).sort_values(["field", "order"])
    families = sorted({f for names in frame["families"] for f in names})
    return frame[frame["field"] == fields[0]], frame[frame["field"] == fields[1]], families


def _in_blocks(patterns: DataFrame, replicates: int, run) -> DataFrame:
    """(year, b, jsd): ``run(year, frame, generator of the block, numbers of its replicates)`` for each year and block of replicates.

    Each block has its own generator, made from the year and the block's number, so results don't depend on partitioning, and
    tasks are as many as years times blocks.
    """
    starts = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(REPLICATES_A_TASK)))

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        year, at = int(key[0]), int(key[1])
        numbers = np.arange(at, min(at + REPLICATES_A_TASK, replicates))
        return pd.DataFrame({"year": year, "b": numbers, "jsd": run(frame, [year, at], len(numbers))})

    dealt = patterns.withColumn("at", starts).groupBy("year", "at")
    return _null_nan(dealt.applyInPandas(task, "year int, b int, jsd double"))


def bootstrap(mentions: DataFrame, fields: tuple[str, str], replicates: int = 2000, seed: int = 20250801) -> DataFrame:
    """(year, b, jsd): papers drawn with replacement within each field and year.

    A draw of papers is a multinomial draw of pattern counts.
    """

    def run(frame: pd.DataFrame, place: list[int], size: int) -> np.ndarray:
        rng = np.random.default_rng([seed, *place])
        left, right, families = _sides(frame, fields)
        sides = [(_matrix(s, families), s["n"].to_numpy()) for s in (left, right)]
        drawn = [rng.multinomial(n.sum(), n / n.sum(), size) @ m if len(n) else np.zeros((size, len(families))) for m, n in sides]
        return _distance(*drawn)

    return _in_blocks(paper_patterns(mentions.where(F.col("field").isin(*fields))), replicates, run)


def rarefied(mentions: DataFrame, fields: tuple[str, str], draws: int = 1000, seed: int = 20250801, permute: bool = False) -> DataFrame:
    """(year, b, jsd) with both fields cut to the smallest number of papers that any field has in any year.

    Papers are drawn without replacement, as multivariate hypergeometric draws of patterns.  With ``permute`` the field labels of a
    year are shuffled before, which gives the distance to expect if the fields didn't differ.
    """
    patterns = paper_patterns(mentions.where(F.col("field").isin(*fields)))
    sizes = patterns.groupBy("year").pivot("field", list(fields)).agg(F.sum("n"))
    least = sizes.select(F.min(F.least(*[F.coalesce(F.col(f"`{f}`"), F.lit(0)) for f in fields])).alias("m")).where("m is not null").first()
    support = int(least["m"]) if least else 0

    def run(frame: pd.DataFrame, place: list[int], size: int) -> np.ndarray:
        rng = np.random.default_rng([seed, *place, int(permute)])
        left, right, families = _sides(frame, fields)
        m = np.vstack([_matrix(left, families), _matrix(right, families)])
        n = np.concatenate([left["n"].to_numpy(), right["n"].to_numpy()]).astype(np.int64)
        n_left = int(left["n"].sum())
        first = rng.multivariate_hypergeometric(n, n_left, size) if permute else np.tile(np.where(np.arange(len(n)) < len(left), n, 0), (size, 1))
        a = np.array([rng.multivariate_hypergeometric(x, support, method="marginals") for x in first])
        b = np.array([rng.multivariate_hypergeometric(n - x, support, method="marginals") for x in first])
        return _distance(a @ m, b @ m)

    return _in_blocks(patterns, draws, run)


def _null_nan(df: DataFrame) -> DataFrame:
    return df.withColumn("jsd", F.when(~F.isnan("jsd"), F.col("jsd")))


def intervals(replicated: DataFrame, by: list[str], value: str = "jsd") -> DataFrame:
    """Mean and 2.5 and 97.5 percentiles (linear interpolation) over replicates."""
    q = lambda p: F.percentile(value, F.lit(p))
    return replicated.groupBy(*by).agg(F.avg(value).alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"))


def contrast_intervals(replicated: DataFrame, early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """The interval of late minus early over replicates that share a number, and whether it excludes 0."""
    each = contrast(replicated, "jsd", early, late, ["b"])
    out = intervals(each.where(F.col("difference").isNotNull()), [], "difference")
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def claim_gate(gate: Column) -> Column:
    """What may be claimed: a change only where the interval excludes 0."""
    return F.when(gate, "supported").otherwise("not supported")


def share_of(df: DataFrame, by: list[str], value: str, name: str = "share") -> DataFrame:
    """A value over its sum in the group."""
    return df.withColumn(name, ratio(F.col(value), F.sum(value).over(Window.partitionBy(*by))))
