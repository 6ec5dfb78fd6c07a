"""Centrality, cores, efficiency and node removal on small graphs, one graph a group.

A graph of concepts has hundreds of nodes however large the corpus; the parallel unit is the graph (definition, window) and, for removal,
the removed node.  Each function takes plain arrays; ``per_graph`` runs it over a DataFrame of edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Adjacency = dict[str, dict[str, float]]


def adjacency(edges: list[tuple[str, str, float]]) -> Adjacency:
    """Undirected; of parallel edges the last counts."""
    out: Adjacency = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def shortest(graph: Adjacency, start: str, without: str | None = None) -> tuple[list[str], dict[str, float], dict[str, list[str]], dict[str, float]]:
    """Dijkstra: nodes by distance, distances, predecessors on shortest paths, and numbers of shortest paths."""
    distance: dict[str, float] = {}
    before: dict[str, list[str]] = {start: []}
    paths = {start: 1.0}
    order: list[str] = []
    best = {start: 0.0}
    heap = [(0.0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in distance:
            continue
        distance[x] = d
        order.append(x)
        for y, w in graph.get(x, {}).items():
            if y == without or y in distance:
                continue
            via = d + w
            if y not in best or via < best[y]:
                best[y], before[y], paths[y] = via, [x], paths[x]
                heapq.heappush(heap, (via, y))
            elif via == best[y]:
                before[y].append(x)
                paths[y] += paths[x]
    return order, distance, before, paths


def betweenness_between(graph: Adjacency, sources: list[str], targets: list[str]) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Shares of shortest paths from sources to targets through each node (ends aside) and edge, scaled as for all ordered pairs.

    Nodes scale by 1 / ((n - 1)(n - 2)) and edges by 1 / (n (n - 1)) of ordered pairs.
    """
    nodes = dict.fromkeys(graph, 0.0)
    edges = {tuple(sorted((a, b))): 0.0 for a in graph for b in graph[a]}
    goal = set(targets)
    for s in sources:
        if s not in graph:
            continue
        order, _, before, paths = shortest(graph, s)
        flow = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            share = (flow[x] + (1.0 if x in goal and x != s else 0.0)) / paths[x]
            for p in before[x]:
                part = paths[p] * share
                edges[tuple(sorted((p, x)))] += part
                flow[p] += part
            if x != s:
                nodes[x] += flow[x]
    n = len(graph)
    node_scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    edge_scale = 1 / (n * (n - 1)) if n > 1 else 1.0
    return {k: v * node_scale for k, v in nodes.items()}, {k: v * edge_scale for k, v in edges.items()}


def efficiency(graph: Adjacency, sources: list[str], targets: list[str], without: str | None = None) -> tuple[float, float]:
    """(mean inverse distance over all source-target pairs, share of pairs with a path), of the ends that are in the graph.

    Pairs without a path, and a node with itself, count 0.  Without a pair the first is NaN and the second 0.
    """
    s, t = (sorted(x for x in set(ends) if x in graph and x != without) for ends in (sources, targets))
    lengths = [shortest(graph, a, without)[1] for a in s]
    found = [distance[b] for distance in lengths for b in t if distance.get(b)]
    pairs = len(s) * len(t)
    return (sum(1 / d for d in found) / pairs, len(found) / pairs) if pairs else (float("nan"), 0.0)


def removal_loss(graph: Adjacency, sources: list[str], targets: list[str], node: str, full: float | None = None) -> float:
    """The relative loss of efficiency without a node, at least 0; NaN where there is none to lose.  ``full`` is the graph's own."""
    full = efficiency(graph, sources, targets)[0] if full is None else full
    if not full > 0:
        return float("nan")
    left = efficiency(graph, sources, targets, node)[0]
    return 0.0 if left > full else (full - left) / full


def core_numbers(graph: Adjacency) -> dict[str, int]:
    """The largest k of a k-core that holds each node; weights and loops don't matter."""
    degree = {x: len(set(ys) - {x}) for x, ys in graph.items()}
    core, k, left = {}, 0, dict(degree)
    heap = [(d, x) for x, d in degree.items()]
    heapq.heapify(heap)
    while heap:
        d, x = heapq.heappop(heap)
        if x in core or d != left[x]:
            continue
        k = max(k, d)
        core[x] = k
        for y in graph[x]:
            if y not in core and y != x:
                left[y] -= 1
                heapq.heappush(heap, (left[y], y))
    return core


def spectral_scores(rows: list[str], columns: list[str], weights: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """Leading singular vectors of a bipartite weight matrix, absolute, each scaled to a maximum of 1."""
    if not weights.size or not weights.any():
        return dict.fromkeys(rows, 0.0), dict.fromkeys(columns, 0.0)
    u, _, v = np.linalg.svd(weights, full_matrices=False)
    left, right = np.abs(u[:, 0]), np.abs(v[0])
    return dict(zip(rows, left / left.max())), dict(zip(columns, right / right.max()))


def eigenvector_centrality(graph: Adjacency) -> dict[str, float]:
    """The leading eigenvector of the weighted adjacency matrix, absolute, scaled to a maximum of 1."""
    names = sorted(graph)
    if not names:
        return {}
    place = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a in graph:
        for b, w in graph[a].items():
            m[place[a], place[b]] = w
    vector = np.abs(np.linalg.eigh(m)[1][:, -1])
    return dict(zip(names, vector / vector.max() if vector.max() > 0 else vector))


def anchors(ratios: dict[str, float], fold: float = 2.0) -> tuple[list[str], list[str]]:
    """Nodes that lean to either field by ``fold``; where a side has none, the one that leans most."""
    cut = np.log2(fold)
    low, high = sorted(x for x, r in ratios.items() if r <= -cut), sorted(x for x, r in ratios.items() if r >= cut)
    ranked = sorted(ratios, key=lambda x: (ratios[x], x))
    return (low or ranked[:1]), (high or ranked[-1:])


def per_graph(edges: DataFrame, by: list[str], distance: str, measure: Callable[[Adjacency], dict[str, float]], name: str) -> DataFrame:
    """(by, node, name): a measure of every node of every graph; a graph's edges are one group."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["source", "target"])
        found = measure(adjacency(list(zip(frame["source"], frame["target"], frame[distance]))))
        return pd.DataFrame([[*key, x, float(v)] for x, v in sorted(found.items())], columns=[*by, "node", name])

    kinds = "".join(f"{c} {edges.schema[c].dataType.simpleString()}, " for c in by)
    return edges.groupBy(*by).applyInPandas(run, f"{kinds}node string, {name} double")


NODES_A_TASK = 16


def removal_effects(edges: DataFrame, by: list[str], distance: str, sources: list[str], targets: list[str], only: DataFrame | None = None) -> DataFrame:
    """(by, node, loss) for every node that isn't an anchor, or of those the ones in ``only`` (by, node), such as the top bridges.

    The work is dealt out by graph and ``NODES_A_TASK`` removed nodes; each such row gets a whole graph, which is small, and finds
    its efficiency once.
    """
    listed = edges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("source", "target", distance))).alias("edges"))
    ends = F.array_distinct(F.concat(F.transform("edges", lambda e: e["source"]), F.transform("edges", lambda e: e["target"])))
    if only is not None:
        listed = listed.join(only.groupBy(*by).agg(F.collect_set("node").alias("only")), by)
        ends = F.array_intersect(ends, "only")
    fixed = F.array(*map(F.lit, [*sources, *targets])).cast("array<string>")
    todo = listed.select(*by, "edges", F.array_sort(F.array_except(ends, fixed)).alias("all")).where(F.size("all") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(NODES_A_TASK)))
    todo = todo.withColumn("at", starts).select(*by, "edges", F.slice("all", F.col("at"), F.lit(NODES_A_TASK)).alias("nodes"), "at").repartition("at", *by)

    def run(batches):
        for frame in batches:
            out = []
            for row in frame.to_dict("records"):
                graph = adjacency([tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in row["edges"]])
                full = efficiency(graph, sources, targets)[0]
                out += [[*(row[c] for c in by), x, removal_loss(graph, sources, targets, x, full)] for x in row["nodes"]]
            yield pd.DataFrame(out, columns=[*by, "node", "loss"])

    kinds = "".join(f"{c} {edges.schema[c].dataType.simpleString()}, " for c in by)
    return todo.mapInPandas(run, f"{kinds}node string, loss double")
