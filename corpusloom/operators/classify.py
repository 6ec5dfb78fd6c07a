"""Tables over papers with several classes each: primary class, shares, cross-listing, coverage and flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.measures import ratio, wilson


def per_paper(classes: DataFrame) -> DataFrame:
    """(key, primary, n_classes, classes) from (key, pos, cls): the class at the lowest position, and all in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "cls")))
    return classes.groupBy("key").agg(
        F.min_by("cls", "pos").alias("primary"), F.count_distinct("cls").alias("n_classes"), F.transform(ordered, lambda x: x["cls"]).alias("classes")
    )


def fractional_weights(classes: DataFrame) -> DataFrame:
    """(key, cls, weight): each class row of a paper weighs one over their number; a class's rows add up."""
    share = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("key"))
    return classes.withColumn("share", share).groupBy("key", "cls").agg(F.sum("share").alias("weight"))


def assignment_shares(classes: DataFrame, papers: DataFrame) -> DataFrame:
    """(scheme, year, cls, weight, n_papers, share): classes under three ways to count, primary class only, any class, and fractional.

    Shares are of all papers of the year that have a class.  The three schemes come from each paper's list of classes, in one pass.
    """
    per = per_paper(classes).join(papers.select("key", "year"), "key").select("key", "year", "primary", "classes")
    entry = lambda scheme, cls, weight: F.struct(F.lit(scheme).alias("scheme"), cls.alias("cls"), weight.cast("double").alias("weight"))
    entries = F.concat(
        F.array(entry("primary", F.col("primary"), F.lit(1))),
        F.transform(F.array_distinct("classes"), lambda c: entry("any", c, F.lit(1))),
        F.transform("classes", lambda c: entry("fractional", c, 1.0 / F.size("classes"))),
    )
    by = per.select("year", F.explode(entries).alias("e")).groupBy("e.scheme", "year", "e.cls").agg(F.sum("e.weight").alias("weight"))
    sizes = per.groupBy("year").agg(F.count_distinct("key").alias("n_papers"))
    joined = by.join(F.broadcast(sizes), "year")  # one row a year
    return joined.select("scheme", "year", "cls", "weight", "n_papers", ratio(F.col("weight"), F.col("n_papers")).alias("share"))


def cross_listing(classes: DataFrame, papers: DataFrame, a: str, b: str) -> DataFrame:
    """Yearly share of papers listed under both of two classes, with its Wilson interval."""
    flags = classes.groupBy("key").agg(F.bool_or(F.col("cls") == a).alias("has_a"), F.bool_or(F.col("cls") == b).alias("has_b"))
    yearly = (
        flags.join(papers.select("key", "year"), "key")
        .groupBy("year")
        .agg(F.count_if(F.col("has_a") & F.col("has_b")).alias("n_cross"), F.count_if(F.col("has_a") | F.col("has_b")).alias("n_either"))
    )
    low, high = wilson(F.col("n_cross"), F.col("n_either"))
    return yearly.select("year", "n_cross", "n_either", ratio(F.col("n_cross"), F.col("n_either")).alias("rate"), low.alias("low"), high.alias("high"))


def document_flow(papers: DataFrame, candidates: DataFrame, included: Column) -> DataFrame:
    """By document type (null: missing) and inclusion: papers, and those that are candidates."""
    known = candidates.select("key").distinct().withColumn("candidate", F.lit(True))
    return (
        papers.join(known, "key", "left")
        .groupBy(F.coalesce("doctype", F.lit("missing")).alias("doctype"), included.alias("included"))
        .agg(F.count(F.lit(1)).alias("n_corpus"), F.count("candidate").alias("n_candidate"))
    )
