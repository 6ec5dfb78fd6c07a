"""Co-occurrence edges, node tables and association measures, for all periods, windows and definitions in one plan.

A loop over periods or windows is never needed: what would be looped over is a grouping column (``by``).
Items are rows (by, doc, item), an item of a document once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.measures import (
    cosine_of_counts,
    entropy_term,
    harmonic_mean,
    jaccard,
    normalised_pmi,
    odds_ratio,
    orientation,
    ratio,
    smoothed_share,
)


def pairs(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, doc, w, source, target) with source < target, from each document's own sorted items; w is 1 over its number of pairs."""
    lists = items.groupBy(*by, "doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    place = F.posexplode("items").alias("i", "source")
    weight = F.try_divide(F.lit(1.0), F.size("items") * (F.size("items") - 1) / 2)
    firsts = lists.select(*by, "doc", "items", weight.alias("w"), place)
    rest = F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))
    return firsts.select(*by, "doc", "w", "source", F.explode(rest).alias("target"))


def association_edges(items: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Edges with at least ``least`` documents: counts, equal-document weight, Jaccard, cosine and normalised PMI.

    A document's weight is one, spread over its pairs.
    """
    population = items.groupBy(*by).agg(F.count_distinct("doc").alias("n_docs"))
    nodes = items.groupBy(*by, "item").agg(F.count_distinct("doc").alias("n"))
    found = pairs(items, by)
    edges = found.groupBy(*by, "source", "target").agg(F.count(F.lit(1)).alias("n_xy"), F.sum("w").alias("weight"))
    edges = edges.where(F.col("n_xy") >= least)
    edges = edges.join(nodes.select(*by, F.col("item").alias("source"), F.col("n").alias("n_x")), [*by, "source"])
    edges = edges.join(nodes.select(*by, F.col("item").alias("target"), F.col("n").alias("n_y")), [*by, "target"])
    edges = edges.join(F.broadcast(population), by) if by else edges.crossJoin(F.broadcast(population))  # a row a period
    p = lambda c: ratio(F.col(c), F.col("n_docs"))
    return edges.withColumns(
        {
            "jaccard": jaccard(F.col("n_xy"), F.col("n_x"), F.col("n_y")),
            "cosine": cosine_of_counts(F.col("n_xy"), F.col("n_x"), F.col("n_y")),
            "npmi": normalised_pmi(p("n_xy"), p("n_x"), p("n_y")),
        }
    )


def strengths(edges: DataFrame, by: list[str], weight: str) -> DataFrame:
    """(by, node, degree, strength, log_strength): sums over a node's edges at either end."""
    ends = F.explode(F.array("source", "target")).alias("node")
    summed = edges.select(*by, ends, weight).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"), F.sum(weight).alias("strength"))
    return summed.withColumn("log_strength", F.log1p("strength"))


def participation(links: DataFrame, by: list[str], node: str, domain: str, weight: str) -> DataFrame:
    """How a node's weight spreads over domains: 1 - sum of squared shares, its value scaled by K/(K-1), entropy over ln K, domains.

    K is the number of domains that the node reaches; scaled values and entropies of a single domain are 0.
    """
    sums = links.groupBy(*by, node, domain).agg(F.sum(weight).alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy(*by, node))
    k = F.count(F.lit(1))
    raw = 1 - F.sum(F.col("s") * F.col("s"))
    return (
        sums.withColumn("s", share)
        .groupBy(*by, node)
        .agg(
            k.alias("n_domains"),
            raw.alias("participation"),
            F.when(k > 1, raw * k / (k - 1)).otherwise(0.0).alias("scaled_participation"),
            F.when(k > 1, F.sum(entropy_term(F.col("s"))) / F.ln(k)).otherwise(0.0).alias("entropy"),
        )
    )


def prominence(mentions: DataFrame, papers: DataFrame, fields: tuple[str, str], by: list[str]) -> DataFrame:
    """Families in two fields: counts, smoothed prevalences, their log ratios, orientation, shared prevalence, odds ratio.

    ``papers`` has every paper of the population (key, field, by), ``mentions`` a paper's families once; a field without a
    mention of a family counts 0 of its papers.
    """
    a, b = fields
    side = lambda f, name: F.count_if(F.col("field") == f).alias(name)
    counts = mentions.groupBy(*by, "family").agg(side(a, "n_a"), side(b, "n_b"))
    totals = papers.groupBy(*by).agg(side(a, "papers_a"), side(b, "papers_b"))
    joined = counts.join(F.broadcast(totals), by) if by else counts.crossJoin(F.broadcast(totals))  # a row a window
    joined = joined.withColumns(
        {"prevalence_a": smoothed_share(F.col("n_a"), F.col("papers_a")), "prevalence_b": smoothed_share(F.col("n_b"), F.col("papers_b"))}
    )
    quotient = F.col("prevalence_b") / F.col("prevalence_a")
    return joined.withColumns(
        {
            "log2_ratio": F.log2(quotient),
            "log10_ratio": F.log10(quotient),
            "orientation": orientation(F.log10(quotient)),
            "shared": harmonic_mean(ratio(F.col("n_a"), F.col("papers_a")), ratio(F.col("n_b"), F.col("papers_b"))),
            "odds_ratio": odds_ratio(F.col("n_b"), F.col("papers_b") - F.col("n_b"), F.col("n_a"), F.col("papers_a") - F.col("n_a")),
        }
    )


def brokerage_edges(items: DataFrame, fields: tuple[str, str], by: list[str], least: int = 5) -> DataFrame:
    """Edges of items with their documents counted by field: shared prevalence, orientation and the distance 1 / mean prevalence."""
    side = lambda f, name: F.count_if(F.col("field") == f).alias(name)
    docs = items.select(*by, "doc", "field").distinct().groupBy(*by).agg(side(fields[0], "docs_a"), side(fields[1], "docs_b"))
    edges = pairs(items, [*by, "field"]).groupBy(*by, "source", "target").agg(F.count(F.lit(1)).alias("n"), side(fields[0], "n_a"), side(fields[1], "n_b"))
    edges = edges.where(F.col("n") >= least)
    edges = edges.join(F.broadcast(docs), by) if by else edges.crossJoin(F.broadcast(docs))  # a row a window
    p_a, p_b = ratio(F.col("n_a"), F.col("docs_a")), ratio(F.col("n_b"), F.col("docs_b"))
    tilt = F.log10(smoothed_share(F.col("n_b"), F.col("docs_b")) / smoothed_share(F.col("n_a"), F.col("docs_a")))
    return edges.withColumns(
        {"shared": harmonic_mean(p_a, p_b), "orientation": orientation(tilt), "distance": F.try_divide(F.lit(2.0), F.coalesce(p_a, F.lit(0.0)) + F.coalesce(p_b, F.lit(0.0)))}
    )


def scaled(df: DataFrame, value: str, by: list[str], kind: str = "identity", name: str = "scaled") -> DataFrame:
    """A measure moved to 0..1 by its least and greatest value in the group, after a square root or log1p; 0.5 where all agree."""
    x = {"identity": F.col(value), "sqrt": F.sqrt(value), "log1p": F.log1p(value)}[kind]
    group = Window.partitionBy(*by)
    low, high = F.min(x).over(group), F.max(x).over(group)
    return df.withColumn(name, F.when(high > low, (x - low) / (high - low)).otherwise(0.5))


def sentence_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidate-target pairs of a sentence, (doc, sentence, source, target, weight): a sentence weighs one, spread over its pairs."""
    s = left.select("doc", "sentence", F.col("item").alias("source")).distinct()
    t = right.select("doc", "sentence", F.col("item").alias("target")).distinct()
    weight = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("doc", "sentence"))
    return s.join(t, ["doc", "sentence"]).withColumn("weight", weight)


def abstract_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidate-target pairs of a document: weight, whether they share a sentence, and their least sentence distance."""
    s = left.select("doc", "sentence", F.col("item").alias("source")).distinct()
    t = right.select("doc", F.col("sentence").alias("other"), F.col("item").alias("target")).distinct()
    gap = F.abs(F.col("sentence") - F.col("other"))
    found = s.join(t, "doc").groupBy("doc", "source", "target").agg(F.min(gap).alias("distance"))
    weight = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("doc"))
    return found.withColumn("same_sentence", F.col("distance") == 0).withColumn("weight", weight)


def relation_edges(relations: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """(by, source, target, relation): supporting documents, events, shares of negated, modal and highly confident ones."""
    share = lambda c: F.avg(c.cast("double"))
    return (
        relations.groupBy(*by, "source", "target", "relation")
        .agg(
            F.count_distinct("doc").alias("n_docs"),
            F.count(F.lit(1)).alias("n_events"),
            share(F.col("negated")).alias("negated_share"),
            share(F.col("modal")).alias("modal_share"),
            share(F.col("confidence") == "high").alias("high_share"),
        )
        .where(F.col("n_docs") >= least)
    )


def quality_flags(occurrences: DataFrame, n_docs: int, short: int = 3, common: float = 0.25) -> DataFrame:
    """(flag, item, n): short lower-case matches, and items that a large share of documents has."""
    low = (F.length("matched") <= short) & (F.col("matched") == F.lower("matched"))
    shorts = occurrences.where(low).groupBy("item").agg(F.count(F.lit(1)).alias("n")).select(F.lit("short_match").alias("flag"), "item", "n")
    many = occurrences.groupBy("item").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= common * n_docs)
    return shorts.unionByName(many.select(F.lit("high_prevalence").alias("flag"), "item", "n"))


def inventory(aliases: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Every alias with its matches and documents, those that never match with 0."""
    counts = occurrences.groupBy("alias").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("doc").alias("n_docs"))
    return aliases.join(counts, "alias", "left").fillna(0, ["n_matches", "n_docs"])
