"""Roles of candidates between two fields: definitions, prominence with its uncertainty, anchors, brokerage and its sensitivity.

Definitions and windows are columns, so that all of their combinations are one plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import graphs
from corpusloom.operators.classify import per_paper


def field_membership(classes: DataFrame, papers: DataFrame, fields: dict[str, str], a: str, b: str) -> DataFrame:
    """(key, year, primary_field, crosslisted): the field of the first class, and whether classes of both fields are there.

    ``fields`` maps class prefixes to fields.
    """
    known = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    field_of = lambda c: F.coalesce(F.try_element_at(known, F.regexp_extract(c, "^[^.]*", 0)), F.lit("other"))
    lists = per_paper(classes).select("key", F.transform("classes", field_of).alias("fields"))
    both = F.array_contains("fields", a) & F.array_contains("fields", b)
    return papers.select("key", "year").join(lists.select("key", F.get("fields", 0).alias("primary_field"), both.alias("crosslisted")), "key")


def defined(candidates: DataFrame, definitions: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Candidates (key, .., family) once for every definition, which renames groups of families; a paper's family counts once.

    A definition is {new name: [families it takes in]}; families it doesn't name stay as they are.
    """
    pairs = [F.struct(F.lit(d).alias("definition"), F.lit(old).alias("old"), F.lit(new).alias("new")) for d, groups in definitions.items() for new, olds in groups.items() for old in olds]
    table = F.array(*pairs) if pairs else F.array().cast("array<struct<definition:string,old:string,new:string>>")
    rows = candidates.withColumn("definition", F.explode(F.array(*map(F.lit, definitions))))
    renamed = F.get(F.filter(table, lambda p: (p["definition"] == F.col("definition")) & (p["old"] == F.col("family"))), 0)["new"]
    return rows.withColumn("family", F.coalesce(renamed, F.col("family"))).distinct()


def prominence_intervals(prominence: DataFrame, by: list[str], replicates: int = 2000, seed: int = 20250801) -> DataFrame:
    """(by, family, log2_low, log2_high): percentiles of the log ratio over binomial redraws of both fields' counts.

    The counts are sufficient statistics, so a window's papers needn't be drawn one by one.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("family")
        rng = np.random.default_rng([seed, *"|".join(map(str, key)).encode()])
        logs = []
        for n, total in (("n_a", "papers_a"), ("n_b", "papers_b")):
            count, size = frame[n].to_numpy(np.int64), frame[total].to_numpy(np.int64)
            drawn = rng.binomial(size, np.divide(count, size, out=np.zeros(len(size)), where=size > 0), (replicates, len(size)))
            logs.append(np.log2((drawn + 0.5) / (size + 1)))
        low, high = np.percentile(logs[1] - logs[0], [2.5, 97.5], axis=0)
        return pd.DataFrame({**{c: k for c, k in zip(by, key)}, "family": frame["family"], "log2_low": low, "log2_high": high})

    kinds = "".join(f"{c} {prominence.schema[c].dataType.simpleString()}, " for c in by)
    return prominence.groupBy(*by).applyInPandas(run, f"{kinds}family string, log2_low double, log2_high double")


def prominence_graph(prominence: DataFrame, by: list[str], fields: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the two-sided graph of fields and families; an edge weighs the family's share of the field's papers."""
    side = lambda f, n, total: F.struct(F.lit(f).alias("source"), F.try_divide(F.col(n), F.col(total)).alias("weight"))
    both = F.explode(F.array(side(fields[0], "n_a", "papers_a"), side(fields[1], "n_b", "papers_b"))).alias("e")
    edges = prominence.select(*by, both, F.col("family").alias("target")).select(*by, "e.source", "target", "e.weight")
    return nodes_of(edges, by).withColumn("kind", F.when(F.col("node").isin(*fields), "field").otherwise("family")), exported(edges)


def exported(edges: DataFrame, weight: str = "weight", least: float = 0.0) -> DataFrame:
    """Edges of positive weight."""
    return edges.where(F.col(weight) > least)


def nodes_of(edges: DataFrame, by: list[str]) -> DataFrame:
    """The nodes that an edge of positive weight joins."""
    return exported(edges).select(*by, F.explode(F.array("source", "target")).alias("node")).distinct()


def pattern_frequency(events: DataFrame, by: list[str]) -> DataFrame:
    """How many documents show each combination of columns."""
    return events.groupBy(*by).agg(F.count_distinct("doc").alias("n_docs"), F.count(F.lit(1)).alias("n_events"))


def on_common_scale(df: DataFrame, value: str, reference: Column, name: str = "scaled") -> DataFrame:
    """A measure over its greatest value among the reference rows, cut at 1: rows of different windows stay comparable."""
    most = df.agg(F.max(F.when(reference, F.col(value))).alias("_most"))
    return df.crossJoin(F.broadcast(most)).withColumn(name, F.least(F.try_divide(F.col(value), F.col("_most")), F.lit(1.0))).drop("_most")  # one row


def anchor_table(ratios: DataFrame, by: list[str], fold: float = 2.0) -> DataFrame:
    """(by, side, node): the nodes that lean to the first (low) or second (high) field, at least one a side."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        low, high = graphs.anchors(dict(zip(frame["node"], frame["log2_ratio"])), fold)
        return pd.DataFrame([[*key, s, x] for s, xs in (("low", low), ("high", high)) for x in xs], columns=[*by, "side", "node"])

    kinds = "".join(f"{c} {ratios.schema[c].dataType.simpleString()}, " for c in by)
    return ratios.groupBy(*by).applyInPandas(run, f"{kinds}side string, node string")


def common_anchors(anchors: DataFrame, by: list[str]) -> DataFrame:
    """The anchors that every graph shares, for each graph: differences between graphs are then not those of their ends."""
    keys = anchors.select(*by).distinct()
    n = keys.agg(F.count(F.lit(1)).alias("n_graphs"))
    shared = anchors.groupBy("side", "node").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).where("n = n_graphs")  # one row
    return keys.crossJoin(F.broadcast(shared.select("side", "node")))  # anchors of one graph at most


def brokerage(edges: DataFrame, anchors: DataFrame, by: list[str], distance: str = "distance") -> DataFrame:
    """(by, node, betweenness, efficiency, loss): of every node that isn't an anchor, between low and high anchors.

    ``efficiency`` is the graph's; ``loss`` what its relative part is without the node.
    """

    def run(key: tuple, es: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        es = es.sort_values(["source", "target"])
        g = graphs.adjacency(list(zip(es["source"], es["target"], es[distance])))
        low, high = (sorted(ends.loc[ends["side"] == s, "node"]) for s in ("low", "high"))
        between = graphs.betweenness_between(g, low, high)[0]
        whole = graphs.efficiency(g, low, high)[0]
        rows = [[*key, x, between[x], whole, graphs.removal_loss(g, low, high, x, whole)] for x in sorted(g) if x not in {*low, *high}]
        return pd.DataFrame(rows, columns=[*by, "node", "betweenness", "efficiency", "loss"])

    kinds = "".join(f"{c} {edges.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{kinds}node string, betweenness double, efficiency double, loss double"
    return edges.groupBy(*by).cogroup(anchors.groupBy(*by)).applyInPandas(run, schema)
