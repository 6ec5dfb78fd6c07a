"""Approximate nearest neighbours by inner product: low-dimensional stable projections, kd-trees and a chi-square stop.

Inner products become distances by one more coordinate: a row x gets sqrt(M^2 - |x|^2), M the largest norm, a query gets 0; then
|q - x|^2 = |q|^2 + M^2 - 2<q, x>.  Gaussian projections to ``DIMS`` dimensions keep distances in this sense: the squared
projected distance over the squared distance has a chi-square distribution with ``DIMS`` degrees of freedom.

A kd-tree over the projections splits space into cells; its upper levels are fitted on a bounded sample and every row is routed through
them, a cell with many rows being cut into chunks by id hash.  Each chunk is stored as an index file whose own kd-tree ends in
leaves.  A query takes leaves by increasing projected distance.  The test: were a row closer than the k-th found, it would lie
within the projected distance r with a probability above ``CONFIDENCE`` if r^2 exceeds that quantile times the k-th's squared
distance.  A leaf or a chunk beyond r ends or skips the search, and of a leaf within r just the rows within r are verified
by their true inner products.  First a query searches its own cell; the k-th score found there then bounds r everywhere else.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import open_file, write_file
from corpusloom.sources.storage import fresh_path, materialize

DIMS = 16
SAMPLE_ROWS = 20_000
CELLS, MOST_CELLS = 8, 4096  # cells grow with the rows, up to what the sample can place
CHUNK_ROWS = 65_536
LEAF_ROWS = 1024
CONFIDENCE = 0.93
QUERY_BLOCK = 512
MARGIN = 1e-9


def chi_square_quantile(p: float, even_dims: int) -> float:
    """Where the chi-square distribution function reaches p, for an even number of degrees of freedom (a Poisson sum)."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        term = total = 1.0
        for j in range(1, even_dims // 2):
            term *= mid / 2 / j
            total += term
        lo, hi = (mid, hi) if 1 - np.exp(-mid / 2) * total < p else (lo, mid)
    return hi


def projection(dim: int, seed: int = 7) -> np.ndarray:
    """Gaussian directions for vectors with the added coordinate."""
    return np.random.default_rng(seed).normal(size=(dim + 1, DIMS))


def inner_products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Products of aligned rows, added up from the first component to the last in double precision."""
    products = rows * queries
    return np.add.accumulate(products, axis=1, out=products)[:, -1]


class Splits:
    """The upper kd-tree: a heap of (dimension, value); 2**levels cells."""

    def __init__(self, sample: np.ndarray, cells: int = CELLS):
        self.levels = max(0, (cells - 1).bit_length())
        self.dim = np.zeros(1 << self.levels, int)
        self.value = np.zeros(1 << self.levels)
        parts = {1: sample}
        for node in range(1, 1 << self.levels):
            part = parts.pop(node)
            if len(part):
                self.dim[node] = int(part.var(axis=0).argmax())
                self.value[node] = float(np.median(part[:, self.dim[node]]))
            right = part[:, self.dim[node]] > self.value[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.value[node])
        return node - (1 << self.levels)


def kd_leaves(points: np.ndarray, most: int = LEAF_ROWS) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree split at medians along the widest dimension."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            leaves.append(rows)
            continue
        part = points[rows]
        order = np.argpartition(part[:, int(np.ptp(part, axis=0).argmax())], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


class Chunk:
    """An index file: vectors and projected points in leaf order, their ids, and each leaf's rows and box in the projection."""

    def __init__(self, uri: str):
        with open_file(uri) as f:
            data = np.load(io.BytesIO(f.read()))
            self.ids, self.vectors, self.points, self.edges, self.low, self.high = (data[k] for k in ("ids", "vectors", "points", "edges", "low", "high"))
        self.longest = float(np.sqrt((self.vectors**2).sum(axis=1).max()))
        self.verified = 0  # pairs whose inner product was computed

    @staticmethod
    def build(uri: str, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaves = kd_leaves(points)
        order = np.concatenate(leaves)
        out = io.BytesIO()
        low = np.stack([points[rows].min(axis=0) for rows in leaves])
        high = np.stack([points[rows].max(axis=0) for rows in leaves])
        np.savez(out, ids=ids[order], vectors=vectors[order], points=points[order], edges=np.cumsum([0, *map(len, leaves)]), low=low, high=high)
        write_file(uri, [out.getvalue()])
        return low.min(axis=0), high.max(axis=0)

    def search(self, qids: np.ndarray, queries: np.ndarray, points: np.ndarray, reach: np.ndarray, floor: np.ndarray, k: int, quantile: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of its best rows here that may be among its k best.

        ``reach`` is |q|^2 + M^2; ``floor`` is the k-th score known so far, or -inf.
        """
        gap = box_gap(points, self.low, self.high)
        order = np.argsort(gap, axis=1, kind="stable")
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in qids]
        floor = floor.copy()
        for step in range(len(self.edges) - 1):
            leaf_of = order[:, step]
            near = gap[np.arange(len(qids)), leaf_of] <= quantile * (reach - 2 * floor)
            if not near.any():
                break
            for leaf in np.unique(leaf_of[near]):
                who = np.flatnonzero(near & (leaf_of == leaf))
                lo, hi = self.edges[leaf], self.edges[leaf + 1]
                open_ = self._within(points[who], lo, hi) <= (quantile * (reach - 2 * floor))[who, None]
                open_ &= self.ids[None, lo:hi] != qids[who][:, None]
                self.verified += int(open_.sum())
                at, row, score = self._verify(queries[who], open_, lo, hi, floor[who], k)
                cuts = np.searchsorted(at, np.arange(len(who) + 1))
                for i, q in enumerate(who):
                    part = slice(cuts[i], cuts[i + 1])
                    if part.start < part.stop:
                        all_ids = np.concatenate([best[q][0], self.ids[row[part]]])
                        all_scores = np.concatenate([best[q][1], score[part]])
                        top = np.lexsort((all_ids, -all_scores))[:k]
                        best[q] = (all_ids[top], all_scores[top])
                        if len(top) == k:
                            floor[q] = max(floor[q], all_scores[top[-1]])
        return best

    def _within(self, points: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Squared projected distances to the rows of a leaf, a little less than true where rounding could matter."""
        rows = self.points[lo:hi]
        squares = (points**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None, :]
        return (1 - MARGIN) * (squares - 2 * points @ rows.T) - MARGIN * squares

    def _verify(self, queries: np.ndarray, open_: np.ndarray, lo: int, hi: int, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the open pairs (query, row of the leaf) those that may be among a query's k best, and their scores in the exact order of
        addition; one matrix product tells which they are."""
        rows = self.vectors[lo:hi]
        rough = np.where(open_, queries @ rows.T, -np.inf)
        take = min(k, hi - lo)
        least = np.partition(rough, hi - lo - take, axis=1)[:, hi - lo - take]
        slack = MARGIN * np.sqrt((queries**2).sum(axis=1)) * self.longest
        at, row = np.nonzero(rough >= np.maximum(np.maximum(least, floor) - slack, -1e300)[:, None])
        return at, row + lo, inner_products(rows[row], queries[at])


def box_gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes."""
    gap = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        off = np.maximum(np.maximum(low[None, :, j] - points[:, None, j], points[:, None, j] - high[None, :, j]), 0)
        gap += off * off
    return gap


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = ~F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of other ids.  Score is the inner
    product in double precision, components added in order; ties go to the smaller id.  Vectors that are null, zero or
    hold null or non-finite components, and rows with a null id, take no part; vectors of different lengths have no inner product, so
    each length is searched by itself.  Rows that repeat an id and its vector count once.  With fewer than k candidates all are returned.
    Other columns are not read.  An empty table gives no row.  The driver holds a bounded sample and 300 bytes a chunk of the index.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    norm = F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")
    shapes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries"), norm)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for shape in shapes.where("queries > 0 and n > 1").orderBy("dim").collect():  # one row a length of vector
        found = found.unionByName(_nearest(rows.where(F.col("dim") == shape["dim"]).drop("dim"), shape["dim"], shape["n"], shape["norm"], k, every, seed))
    return found


def _nearest(rows: DataFrame, dim: int, n: int, longest: float, k: int, every: int, seed: int) -> DataFrame:
    """``nearest`` for n rows (vec_id, vector) of one length; ``longest`` is the largest squared norm."""
    spark = rows.sparkSession
    directions = projection(dim, seed)
    quantile = chi_square_quantile(CONFIDENCE, DIMS)

    def project(matrix: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(longest - (matrix**2).sum(axis=1), 0))
        return matrix @ directions[:-1] + more[:, None] * directions[-1]

    share = min(1.0, SAMPLE_ROWS / n)
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(place < share).select("vector").toPandas()["vector"]
    n_cells = min(MOST_CELLS, max(CELLS, n // CHUNK_ROWS))
    splits = Splits(project(_matrix(sample)) if len(sample) else np.zeros((0, DIMS)), n_cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = project(_list_matrix(batch.column(1), dim))
            cells = pa.array(splits.cell(points).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], ["vec_id", "vector", "cell"])

    routed = materialize(rows.mapInArrow(route, "vec_id long, vector array<double>, cell int"), "op5-routed")
    counts = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_chunk = max(1, min(CHUNK_ROWS, -(-n // n_cells)))
    cuts = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, -(-m // per_chunk))])
    folder = fresh_path(spark, "op5-index")
    chunked = routed.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), cuts[F.col("cell")]).cast("int"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(frame["vector"])
        ids = frame["vec_id"].to_numpy()
        whole = np.ascontiguousarray(np.column_stack([ids.astype(float), matrix]))
        keep = np.sort(np.unique(whole, axis=0, return_index=True)[1]) if len(np.unique(ids)) < len(ids) else np.arange(len(ids))
        path = f"{folder}/cell-{key[0]:05d}-{key[1]:06d}.npz"
        low, high = Chunk.build(path, ids[keep], matrix[keep], project(matrix[keep]))
        return pd.DataFrame({"cell": [key[0]], "path": [path], "low": [low], "high": [high]})

    index = materialize(
        chunked.groupBy("cell", "part").applyInPandas(build, "cell int, path string, low array<double>, high array<double>"), "op5-chunks"
    )
    queries = materialize(routed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"]), "op5-queries")

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(key[0])
        matrix, ids = _matrix(frame["vector"]), frame["vec_id"].to_numpy()
        points, reach = matrix @ directions[:-1], (matrix**2).sum(axis=1) + longest
        best = chunk.search(ids, matrix, points, reach, frame["floor"].to_numpy(float), k, quantile)
        lengths = [len(b[0]) for b in best]
        return pd.DataFrame(
            {
                "query_id": np.repeat(ids, lengths),
                "vec_id": np.concatenate([b[0] for b in best]),
                "score": np.concatenate([b[1] for b in best]),
            }
        )

    found_ddl = "query_id long, vec_id long, score double"

    def searched(pairs: DataFrame) -> DataFrame:
        """Queries meet a chunk in blocks, so that no task holds all queries of a popular chunk."""
        blocks = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(max(1, -(-n // every // QUERY_BLOCK))))
        return pairs.withColumn("block", blocks).groupBy("path", "block").applyInPandas(search, found_ddl)

    # A query's own cell by its point with the added coordinate 0; its chunks are all parts of that cell.
    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = splits.cell(_list_matrix(batch.column(1), dim) @ directions[:-1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells)], ["vec_id", "vector", "cell"])

    first = queries.select("vec_id", "vector").mapInArrow(home, "vec_id long, vector array<double>, cell int")
    near = materialize(
        searched(first.join(index.select("cell", "path"), "cell").select("vec_id", "vector", "path", F.lit(float("-inf")).alias("floor"))), "op5-near"
    )
    floors = _best(near, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.select("query_id", F.when(F.col("n") == k, F.col("floor")).otherwise(float("-inf")).alias("floor"))
    bounded = queries.select("vec_id", "vector").join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    boxes = index.orderBy("path").toPandas()  # one row a chunk: rows / CHUNK_ROWS of them
    cells, paths = boxes["cell"].to_numpy(), boxes["path"].tolist()
    low, high = _matrix(boxes["low"]), _matrix(boxes["high"])

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _list_matrix(batch.column(1), dim)
            floor = batch.column(2).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
            points, reach = matrix @ directions[:-1], (matrix**2).sum(axis=1) + longest
            far = box_gap(points, low, high) <= quantile * (reach - 2 * floor)[:, None]
            far &= cells[None, :] != splits.cell(points)[:, None]
            q, c = np.nonzero(far)
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([paths[x] for x in c], pa.string()), pa.array(floor[q])],
                ["vec_id", "vector", "path", "floor"],
            )

    pairs = bounded.select("vec_id", "vector", "floor").mapInArrow(reachable, "vec_id long, vector array<double>, path string, floor double")
    return _best(near.unionByName(searched(pairs)), k).select("query_id", "rank", "vec_id", "score")


def _list_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked; the limit also applies before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
