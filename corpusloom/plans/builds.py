"""The three pipelines as functions: tables and parameters in, named DataFrames out; nothing runs before a table is used.

Callers that use several of a build's tables should write its inputs to storage first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.matching import Lexicon
from corpusloom.functions.measures import not_among
from corpusloom.operators import classify, divergence, edges, extraction, roles, tables


@dataclass(frozen=True)
class AnalysisParameters:
    fields: tuple[str, str]
    early: tuple[int, int]
    late: tuple[int, int]
    top_k: int = 9
    replicates: int = 2000
    draws: int = 1000
    seed: int = 20250801
    ks: tuple[int, ...] = tuple(range(3, 21))
    generic: str | None = None
    excluded_types: tuple[str, ...] = ()


def build_all(papers: DataFrame, classes: DataFrame, mentions: DataFrame, p: AnalysisParameters) -> dict[str, DataFrame]:
    """Classification and divergence tables from papers (key, year, field, doctype), classes (key, pos, cls) and mentions (key, year, field, family)."""
    mentions = mentions.select("key", "year", "field", "family").distinct()
    tracked = mentions.join(divergence.top_families(mentions, p.top_k, p.fields), "family", "left_semi")
    yearly = divergence.distances(divergence.field_shares(tracked, p.fields, ["year"]), ["year"])
    drawn = divergence.bootstrap(tracked, p.fields, p.replicates, p.seed)
    rare = divergence.rarefied(tracked, p.fields, p.draws, p.seed)
    null = divergence.rarefied(tracked, p.fields, p.draws, p.seed, permute=True)
    weighted = divergence.paper_weights(tracked)
    flagged = tables.member_flag(papers, classes, ["key"], "classified")
    primary = classify.per_paper(classes).select("key", F.col("primary").alias("cls"))
    out = {
        "classification_primary_yearly": divergence.share_of(primary.join(papers.select("key", "year"), "key").groupBy("year", "cls").agg(F.count(F.lit(1)).alias("n")), ["year"], "n"),
        "classification_assignment_shares": classify.assignment_shares(classes, papers),
        "classification_coverage_by_year": tables.coverage(flagged, ["year"], F.col("classified")),
        "classification_coverage_by_type": tables.coverage(flagged.fillna("missing", ["doctype"]), ["doctype"], F.col("classified")),
        "document_flow": classify.document_flow(papers, mentions, not_among(F.col("doctype"), list(p.excluded_types))),
        "divergence_yearly": yearly,
        "divergence_intervals": divergence.intervals(drawn, ["year"]),
        "divergence_contrast": divergence.contrast(yearly, "jsd", p.early, p.late),
        "divergence_contrast_interval": divergence.contrast_intervals(drawn, p.early, p.late).withColumn("claim", divergence.claim_gate(F.col("excludes_zero"))),
        "rarefied_intervals": divergence.intervals(rare, ["year"]),
        "permuted_intervals": divergence.intervals(null, ["year"]),
        "bias_summary": divergence.contrast_intervals(rare, p.early, p.late).withColumn("kind", F.lit("rarefied")).unionByName(
            divergence.contrast_intervals(_excess(rare, null), p.early, p.late).withColumn("kind", F.lit("excess over null"))
        ),
        "log_ratios": divergence.log_ratios(tracked, p.fields),
        "composition": divergence.share_of(tracked.groupBy("year", "field", "family").agg(F.count(F.lit(1)).alias("n")), ["year", "field"], "n"),
        "equal_paper_yearly": divergence.distances(divergence.field_shares(weighted, p.fields, ["year"], F.col("weight")), ["year"]),
        "selection_sensitivity": divergence.selection_sensitivity(mentions, p.fields, list(p.ks)),
    }
    if p.generic:
        specific = divergence.suppress_generic(tracked, p.generic)
        out["specific_yearly"] = divergence.distances(divergence.field_shares(specific, p.fields, ["year"]), ["year"])
    return out


def _excess(rare: DataFrame, null: DataFrame) -> DataFrame:
    mean = null.groupBy("year").agg(F.avg("jsd").alias("expected"))
    return rare.join(F.broadcast(mean), "year").select("year", "b", (F.col("jsd") - F.col("expected")).alias("jsd"))  # a row a year


@dataclass(frozen=True)
class NetworkParameters:
    periods: tuple[tuple[int, int, str], ...] = ()
    least_docs: int = 5
    least_relation_docs: int = 2
    reach: int = 180
    types: tuple[str, ...] = field(default=())


def build_network(papers: DataFrame, lexicon: Lexicon, p: NetworkParameters = NetworkParameters(), found: DataFrame | None = None) -> dict[str, DataFrame]:
    """Occurrences, events, edges and nodes from papers (doc, year, text).

    ``found`` is the table of ``extraction.matches`` if it was stored.  Each paper takes part in the whole range and in its period,
    so period tables need no loop.
    """
    found = extraction.matches(papers, lexicon, p.reach) if found is None else found
    tables_ = extraction.events(found)
    spans = [("all", -(10**6), 10**6), *((label, a, b) for a, b, label in p.periods)]
    dated = tables.in_windows(papers.select("doc", "year"), spans).withColumnRenamed("window", "period").select("doc", "period")
    occurrences = tables_["occurrences"].join(dated, "doc")
    items = occurrences.select("period", "doc", "item").distinct()
    population = occurrences.groupBy("period").agg(F.count_distinct("doc").alias("n_docs"))
    counts = items.groupBy("period", "item").agg(F.count(F.lit(1)).alias("n"))

    def event_edges(events: DataFrame, extra: list) -> DataFrame:
        grouped = events.join(dated, "doc").groupBy("period", "source", "target")
        e = grouped.agg(F.count_distinct("doc").alias("n_xy"), F.sum("weight").alias("weight"), *extra).where(F.col("n_xy") >= p.least_docs)
        e = e.join(counts.select("period", F.col("item").alias("source"), F.col("n").alias("n_x")), ["period", "source"])
        e = e.join(counts.select("period", F.col("item").alias("target"), F.col("n").alias("n_y")), ["period", "target"])
        e = e.join(F.broadcast(population), "period")  # a row a period
        share = lambda c: F.col(c) / F.col("n_docs")
        return e.withColumns(
            {
                "jaccard": edges.jaccard(F.col("n_xy"), F.col("n_x"), F.col("n_y")),
                "cosine": edges.cosine_of_counts(F.col("n_xy"), F.col("n_x"), F.col("n_y")),
                "npmi": edges.normalised_pmi(share("n_xy"), share("n_x"), share("n_y")),
            }
        )

    sentence = event_edges(tables_["cooccurrence_events"], [])
    near = [F.avg(F.col("same_sentence").cast("int")).alias("same_sentence_share"), F.avg("distance").alias("mean_distance")]
    abstract = event_edges(tables_["abstract_cooccurrence_events"], near)
    relation = edges.relation_edges(tables_["relation_events"].join(dated, "doc"), ["period"], p.least_relation_docs)
    kinds = occurrences.select("item", "type", "label").distinct()
    linked = abstract.join(kinds.select(F.col("item").alias("target"), F.col("type").alias("domain")).distinct(), "target")
    return tables_ | {
        "sentence_edges": sentence,
        "abstract_edges": abstract,
        "relation_edges": relation,
        "nodes": counts.join(kinds, "item").join(edges.strengths(abstract, ["period"], "weight").withColumnRenamed("node", "item"), ["period", "item"], "left"),
        "bridges": edges.participation(linked.select("period", "source", "domain", "weight"), ["period"], "source", "domain", "weight"),
        "pattern_frequency": roles.pattern_frequency(tables_["abstract_cooccurrence_events"].join(dated, "doc"), ["period", "same_sentence"]),
    }


def build_role_graphs(
    papers: DataFrame, candidates: DataFrame, items: DataFrame, fields: tuple[str, str], windows: list[tuple[str, int, int]],
    definitions: dict[str, dict[str, list[str]]], least_docs: int = 5, replicates: int = 2000,
) -> dict[str, DataFrame]:
    """Prominence, importance and brokerage for every definition and window.

    papers (key, year, field), candidates (key, year, field, family), items (doc, year, field, item): the concepts of each paper, its
    candidates among them.
    """
    by = ["definition", "window"]
    two = lambda df: df.where(F.col("field").isin(*fields))
    named = tables.in_windows(roles.defined(two(candidates), definitions), windows)
    every = tables.in_windows(two(papers).withColumn("definition", F.explode(F.array(*map(F.lit, definitions)))), windows)
    prominence = edges.prominence(named, every, fields, by)
    concepts = roles.defined(two(items).withColumnRenamed("item", "family"), definitions).withColumnRenamed("family", "item")
    windowed = tables.in_windows(concepts, windows)
    broker_edges = edges.brokerage_edges(windowed.select(*by, "doc", "field", "item"), fields, by, least_docs)
    leaning = edges.prominence(windowed.select(*by, "field", F.col("item").alias("family")), every, fields, by)
    anchors = roles.anchor_table(leaning.select(*by, F.col("family").alias("node"), "log2_ratio"), by)
    nodes, graph = roles.prominence_graph(prominence, by, fields)
    return {
        "prominence": prominence.join(roles.prominence_intervals(prominence, by, replicates), [*by, "family"]),
        "prominence_nodes": nodes,
        "prominence_edges": graph,
        "participation": edges.participation(named.select(*by, "family", "field", F.lit(1.0).alias("w1")), by, "family", "field", "w1"),
        "importance_edges": edges.association_edges(windowed.select(*by, "doc", "item"), by, least_docs),
        "brokerage_edges": broker_edges,
        "anchors": anchors,
        "brokerage": roles.brokerage(broker_edges, anchors, by),
        "brokerage_common_ends": roles.brokerage(broker_edges, roles.common_anchors(anchors, by), by),
    }
