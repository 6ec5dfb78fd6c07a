"""Measures of counts and shares as column expressions.

Where a quotient has no value (a zero denominator) the result is null, never an error.
"""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # the normal quantile of a two-sided 95 % interval


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a share k/n."""
    p = ratio(k, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z / 4), n), n)) / scale
    return centre - half, centre + half


def jensen_shannon_term(p: Column, q: Column) -> Column:
    """One category's part of the base-2 Jensen-Shannon divergence; 0 log 0 is 0."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return part(p) + part(q)


def normalised_pmi(p_xy: Column, p_x: Column, p_y: Column) -> Column:
    """Pointwise mutual information over its greatest value: 1 where the pair is everywhere, null where a share isn't positive."""
    value = F.ln(p_xy / (p_x * p_y)) / -F.ln(p_xy)
    positive = (p_xy > 0) & (p_x > 0) & (p_y > 0)
    return F.when(positive & (p_xy >= 1), F.lit(1.0)).when(positive, value)


def jaccard(n_xy: Column, n_x: Column, n_y: Column) -> Column:
    return ratio(n_xy, n_x + n_y - n_xy)


def cosine_of_counts(n_xy: Column, n_x: Column, n_y: Column) -> Column:
    return ratio(n_xy, F.sqrt(n_x.cast("double") * n_y))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a d) / (b c) with half a count added to each cell."""
    return (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))


def smoothed_share(count: Column, total: Column) -> Column:
    """A prevalence pulled towards one half by one pseudo-observation."""
    return (count + 0.5) / (total + 1)


def harmonic_mean(a: Column, b: Column) -> Column:
    """2ab / (a + b), 0 unless both are positive."""
    return F.when((a > 0) & (b > 0), 2 * a * b / (a + b)).otherwise(0.0)


def orientation(log10_ratio: Column, limit: float = 1.0) -> Column:
    """A clipped log ratio moved to 0..1; 0.5 is balance."""
    return (F.greatest(F.least(log10_ratio, F.lit(limit)), F.lit(-limit)) + limit) / (2 * limit)


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def first_match(value: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The label of the first prefix that a value starts with; ``other`` for the rest and for null."""
    if not rules:
        return F.lit(other)
    chain = reduce(lambda c, r: c.when(value.startswith(r[0]), r[1]), rules[1:], F.when(value.startswith(rules[0][0]), rules[0][1]))
    return chain.otherwise(other)


def period_of(year: Column, periods: list[tuple[int, int, str]]) -> Column:
    """The label of the first period (first and last year included) that holds the year; null outside all."""
    first, *rest = periods
    chain = F.when(year.between(first[0], first[1]), first[2])
    for a, b, label in rest:
        chain = chain.when(year.between(a, b), label)
    return chain


def not_among(value: Column, excluded: list[str]) -> Column:
    """Whether a value is none of the excluded; a null isn't."""
    return ~F.coalesce(value.isin(excluded), F.lit(False))


def first_nonblank(values: Column) -> Column:
    """The first element that is neither null nor blank, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), 0)


def span_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters between two spans; 0 where they touch or overlap."""
    return F.greatest(b_start - a_end, a_start - b_end, F.lit(0))


def confidence(distance: Column, between: Column) -> Column:
    """high within 80 characters, or within 120 where the cue stands between; else medium."""
    return F.when((distance <= 80) | (between & (distance <= 120)), "high").otherwise("medium")


def snippet(text: Column, start: Column, end: Column, radius: int = 30) -> Column:
    """The text around a span (offsets from 0)."""
    first = F.greatest(start - radius, F.lit(0))
    return F.substring(text, first + 1, F.least(end + radius, F.char_length(text)) - first)


def slug(value: Column) -> Column:
    """Lower case, the Greek letter nu spelled out, everything else but letters and digits as single underscores."""
    plain = F.regexp_replace(F.replace(F.lower(value), F.lit("ν"), F.lit("nu")), "[^a-z0-9]+", "_")
    trimmed = F.trim(plain, F.lit("_"))
    return F.when(trimmed == "", "unknown").otherwise(trimmed)


def unescaped(text: Column) -> Column:
    """Character references of HTML, named or numbered, as characters."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return run(text)


def strip_tags(page: Column) -> Column:
    """Text without tags, character references resolved, white space squeezed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(page, "<[^>]*>", "")), "[ \\t\\n\\x0B\\f\\r]+", " "))
