"""Near-duplicate documents by MinHash and an LSH forest, confirmed on full shingle sets.

1. Every whole text becomes a sketch: its number of shingles, a digest of the sorted set, one byte of each MinHash
   value, and the hash of its first ``DEPTH`` values in each of ``TREES`` signature orders (rotations, so that these
   prefixes are disjoint).  Texts with equal sets form a class, one node of the graph.
2. Nodes that share the prefix of an order are a region of the forest.  All regions are sorted by the whole rotated signature,
   and a node is compared with the ``WINDOW`` nodes after it, which have the longest common prefixes with it: the denser
   a region, the deeper the prefix that neighbours share.  Neighbours whose signature estimate may reach the
   threshold join into families.  This is linear in the nodes.
3. Regions larger than the window that still hold several families are compared whole, but only across families: the largest
   family of such a region meets the rest, and the rest meets itself, in pairs of blocks.  Nothing that shares a region is missed.
4. Families are confirmed on full sets.  Up to ``BLOCK`` nodes are one task that finds all links.  Larger families
   are cut into runs of ``BLOCK`` nodes of two sorted orders, and links contract them to components; then the nodes outside the
   largest component meet the ``PIVOTS`` nodes with most links; what is still apart is compared whole, as in 3, only
   across components.  A family that is linked through and through costs three transfers of each set.

Only spanning forests of links are written.  No step gathers a hot group: exact copies are one node, and classes and
components are looked up by joins that can be split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.groups import Forest, group_edges, in_slices, whole_groups
from corpusloom.llm.shingles import MinHash, mix, shingle_sets
from corpusloom.operators.components import connected_components
from corpusloom.sources.storage import Scratch

HASHES = 128  # MinHash values, kept as one byte each
TREES, DEPTH = 25, 5
WINDOW = 16
BLOCK = 128
PIVOTS = 16
BROADCAST_IDS = 2_000_000  # about 50 bytes each
SLACK = 4.5  # standard deviations of a signature estimate that a true link may fall short


def _text_blocks(texts: list[str | None], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= chars):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def forest_labels(signatures: np.ndarray) -> np.ndarray:
    """The first DEPTH values of each tree's order as one 64-bit label, different between trees."""
    out = np.empty((len(signatures), TREES), np.uint64)
    for t in range(TREES):
        label = np.full(len(signatures), t + 1, np.uint64)
        for j in range(DEPTH):
            label = mix(label * np.uint64(0x100000001B3) + signatures[:, DEPTH * t + j].astype(np.uint64))
        out[:, t] = label
    return out.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, bytes, labels); the last three are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(HASHES)
        for batch in in_slices(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _text_blocks(texts):
                sets = shingle_sets(texts[a:b], words)
                full = [s for s in sets if len(s)]
                signatures = minhash.signatures(full)
                labels = iter(forest_labels(signatures).tolist())
                low = iter(signatures.astype(np.uint8))
                digests = [_digest(s) if len(s) else None for s in sets]
                columns = [
                    ids.slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(labels) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "bytes", "labels"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, bytes binary, labels array<long>")


def forest(nodes: DataFrame, tables: Scratch) -> DataFrame:
    """(region, size, node, n, rest): each node in the regions of two or more nodes that it belongs to.

    ``rest`` is the signature as that order reads it after the region's prefix: the sort key within the region, and with
    the prefix all there is to compare.
    """
    entries = nodes.select("node", F.posexplode("labels").alias("tree", "region"))
    sizes = entries.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    at = F.col("tree") * DEPTH
    rest = F.concat(F.col("bytes").substr(at + DEPTH + 1, F.lit(HASHES)), F.col("bytes").substr(F.lit(1), at))
    shared = entries.join(sizes, "region")
    rows = shared.join(nodes.select("node", "n_shingles", "bytes"), "node").select("region", "size", "node", F.col("n_shingles").alias("n"), rest.alias("rest"))
    return tables.write(rows, "forest")


def _least_equal(threshold: float) -> int:
    """How many of the signature's bytes must agree for a pair to be worth a look."""
    at = threshold + (1 - threshold) / 256
    return int(np.floor(HASHES * at - SLACK * np.sqrt(HASHES * at * (1 - at))))


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def neighbour_edges(rows: DataFrame, least: int) -> DataFrame:
    """(src, dst) of near nodes among each node's ``WINDOW`` successors in its sorted region, and (region) of regions that
    a partition's end cuts.

    Pairs that earlier pairs of a batch connect already are not written.
    """
    dealt = rows.repartitionByRange("region", "rest", "node").sortWithinPartitions("region", "rest", "node")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("region", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        here: dict[int, int] = {}  # rows still to come of the first and the last region seen
        for batch in in_slices(batches, 8192):
            region, node, rest = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes_matrix(batch.column(3))
            ends = (int(region[0]), int(region[-1]))
            here = {r: n for r, n in here.items() if n}
            for r in dict.fromkeys([*here, *ends]):
                of_r = region == r
                here[r] = here.get(r, int(batch.column(2)[int(of_r.argmax())].as_py())) - int(of_r.sum()) if of_r.any() else here[r]
            if held is not None:
                region, node, rest = (np.concatenate(x) for x in zip(held, (region, node, rest)))
            joined = Forest(len(node))
            found = []
            chain = np.arange(len(node))
            for w in range(1, min(WINDOW, len(node) - 1) + 1):
                a = np.flatnonzero((region[:-w] == region[w:]) & (chain[:-w] != chain[w:]))
                a = a[(rest[a] == rest[a + w]).sum(axis=1) + DEPTH >= least]
                found += [(x, x + w) for x in a.tolist() if joined.join(x, x + w)]
                if w == 1:  # from here on, what a chain of next neighbours connects needs no second look
                    linked = np.zeros(len(node), bool)
                    linked[a + 1] = True
                    chain = np.cumsum(~linked)
            if found:
                pairs = node[np.array(found)]
                columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            held = (region[-WINDOW:], node[-WINDOW:], rest[-WINDOW:])
        cut = [r for r, n in here.items() if n]
        yield pa.RecordBatch.from_pydict({"src": [None] * len(cut), "dst": [None] * len(cut), "region": cut}, schema)

    return dealt.select("region", "node", "size", "rest").mapInArrow(run, "src long, dst long, region long")


def across(rows: DataFrame, tables: Scratch, name: str) -> DataFrame:
    """Deal rows (cluster, node, part, ...) out to tasks in which any two of a cluster's rows of different parts meet.

    The largest part of a cluster is cut into blocks, and so is the rest; every block of the rest meets every block, while
    blocks of the largest part, which have nothing to tell each other, don't meet.  Clusters of one part are left out.
    Adds ``task`` and ``main``, whether the row is of the largest part.
    """
    half = BLOCK // 2
    parts = rows.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("c"))
    tops = parts.groupBy("cluster").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("all")).where(F.col("top.c") < F.col("all"))
    tops = tables.write(
        tops.select(
            "cluster", F.col("top.part").alias("main_part"),
            F.ceil(F.col("top.c") / half).cast("int").alias("main_blocks"), F.ceil((F.col("all") - F.col("top.c")) / half).cast("int").alias("rest_blocks"),
        ),
        name,
    )
    main = F.col("part") == F.col("main_part")
    block = F.when(main, F.col("rest_blocks") + F.pmod(F.xxhash64("node"), F.col("main_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest_blocks")))
    others = F.when(main, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks"))
    met = rows.join(tops, "cluster").withColumn("main", main).withColumn("block", block.cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    single = (F.col("rest_blocks") == 1) & (F.col("main_blocks") == 1)
    met = met.where(~single | (F.col("other") == 0))
    task = F.when(single, F.xxhash64("cluster")).otherwise(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")))
    return met.withColumn("task", task)


def _near_pairs(part: np.ndarray, main: np.ndarray, n: np.ndarray, sig: np.ndarray, least: int, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row outside the largest part, later rows of other parts with which it may reach the threshold."""
    order = np.argsort(main, kind="stable")  # the rest first: only it looks for partners
    part, n, sig = part[order], n[order], sig[order]
    for i in range(int((~main).sum())):
        at = np.flatnonzero((part[i + 1 :] != part[i]) & (den * np.minimum(n[i + 1 :], n[i]) >= num * np.maximum(n[i + 1 :], n[i]))) + i + 1
        at = at[(sig[at] == sig[i]).sum(axis=1) >= least]
        if len(at):
            yield order[i], order[at]


def _screened(dealt: DataFrame, least: int, num: int, den: int, schema: str, emit) -> DataFrame:
    """Run ``emit`` over the near pairs of each task of rows (task, node, part, main, n, sig)."""
    rows = dealt.select("task", "node", "part", "main", "n", "sig").repartition("task").sortWithinPartitions("task", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "task"):
            task, node, part, main, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            sig = _bytes_matrix(batch.column(5))
            edges = group_edges(task)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                pairs = list(_near_pairs(part[lo:hi], main[lo:hi], n[lo:hi], sig[lo:hi], least, num, den))
                if pairs:
                    yield emit(int(task[lo]), node[lo:hi], part[lo:hi], pairs)

    return rows.mapInArrow(run, schema)


def _part_edges(task: int, node: np.ndarray, part: np.ndarray, pairs: list) -> pa.RecordBatch:
    """A spanning forest of the parts that the pairs connect."""
    names, number = np.unique(part, return_inverse=True)
    forest_ = Forest(len(names))
    found = forest_.spanning(*zip(*((number[i], number[j]) for i, js in pairs for j in js.tolist())))
    return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], ["src", "dst"])


def _task_members(task: int, node: np.ndarray, part: np.ndarray, pairs: list) -> pa.RecordBatch:
    """The nodes of a task that have a partner in it."""
    rows = np.unique(np.concatenate([np.append(js, i) for i, js in pairs]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), task, np.int64)), pa.array(node[rows]), pa.array(part[rows])], ["task", "node", "part"])


def families(rows: DataFrame, num: int, den: int, tables: Scratch) -> DataFrame:
    """(node, family) for nodes that may be linked: families hold every pair of a region that may reach the threshold.

    ``rows`` are those of ``forest``.
    """
    least = _least_equal(num / den)
    found = tables.write(neighbour_edges(rows, least), "neighbours")
    first = tables.write(connected_components(found.where("src is not null").select("src", "dst")), "families-first")
    cut = found.where("region is not null").select("region").distinct()
    inside = F.col("size") <= WINDOW + 1
    loose = rows.where(~inside).unionByName(rows.where(inside).join(F.broadcast(cut), "region", "left_semi"))  # two cut regions a partition
    labels = first.select("node", F.col("component").alias("family"))
    loose = loose.join(labels, "node", "left").select("region", "node", "n", F.coalesce("family", "node").alias("part"), F.col("rest").alias("sig"))
    # Linked sets differ in size by num / den at most: they are in the same class of sizes or in neighbouring ones.
    step = F.floor(F.log("n") / math.log(den / num))
    classed = loose.withColumn("step", F.explode(F.array(step, step + 1))).withColumn("cluster", F.xxhash64("region", "step")).drop("region", "step")
    classed = tables.write(classed, "loose")
    if classed.isEmpty():
        return labels
    dealt = across(classed, tables, "loose-clusters")
    second = tables.write(_screened(dealt, least - DEPTH, num, den, "src long, dst long", _part_edges).distinct(), "family-edges")
    if second.isEmpty():
        return labels
    merged = tables.write(connected_components(second), "families-second").select(F.col("node").alias("family"), "component")
    ends = labels.unionByName(second.select(F.explode(F.array("src", "dst")).alias("family")).distinct().select(F.col("family").alias("node"), "family"))
    ends = ends.distinct().join(merged, "family", "left")
    return ends.select("node", F.coalesce("component", "family").alias("family")).distinct()


def exact_links(sets: list[np.ndarray], num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a spanning forest of the pairs with den * |a & b| >= num * |a | b|, with how many others each set pairs).

    Shingles that only one set has can't be shared and are dropped; what is left makes a dense
    incidence matrix in slices, whose products with itself are the sizes of all intersections.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    joined = np.concatenate(sets)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    runs = group_edges(joined)
    length = np.diff(runs)
    shared = np.repeat(length > 1, length)
    column = np.repeat(np.cumsum(length > 1) - 1, length)[shared]
    row = owner[shared]
    both = np.zeros((n, n), np.float32)
    width = max(1, 2_000_000 // max(n, 1))
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, min(width, total - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    linked = (den * both >= num * union) & (both > 0)
    np.fill_diagonal(linked, False)
    x, y = np.nonzero(np.triu(linked, 1))
    return Forest(n).spanning(x.tolist(), y.tolist()), linked.sum(axis=1)


def sorted_runs(members: DataFrame) -> DataFrame:
    """(task, node): each large family in two sorted orders, cut into runs of ``BLOCK`` nodes."""
    half = HASHES // 2
    turned = F.concat(F.col("bytes").substr(half + 1, half), F.col("bytes").substr(1, half))
    orders = F.array(F.struct(F.lit(0).alias("turn"), F.col("bytes").alias("key")), F.struct(F.lit(1).alias("turn"), turned.alias("key")))
    rows = members.select("family", "node", F.explode(orders).alias("o")).select("family", "o.turn", "o.key", "node")
    rows = rows.repartitionByRange("family", "turn", "key", "node").sortWithinPartitions("family", "turn", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, filled, open_ = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for batch in batches:
            tasks = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != open_ or filled == BLOCK:
                    task, filled, open_ = task + 1, 0, key
                filled += 1
                tasks.append(task)
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), batch.column(2)], ["task", "node"])

    return rows.select("family", "turn", "node").mapInArrow(run, "task long, node long")


def confirmed_links(texts: DataFrame, dealt: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links on full sets between nodes of a task: (src, dst), a spanning forest of each task, and (src, degree) of its best linked node.

    ``dealt`` has (task, node, doc_id, digest); ``texts`` has (doc_id, text), of which those whose set has the digest count.
    """
    wanted = dealt.groupBy("node", "doc_id", "digest").agg(F.collect_list("task").alias("tasks"))
    if dealt.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, "doc_id").select("node", "digest", "tasks", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts, digests = batch.column(3).to_pylist(), batch.column(1).to_pylist()
            for a, b in _text_blocks(texts):
                sets = shingle_sets(texts[a:b], words)
                rows = [i for i, s in enumerate(sets) if _digest(s) == digests[a + i]]
                take = pa.array([a + i for i in rows], pa.int64())
                columns = [batch.column(0).take(take), batch.column(2).take(take), pa.array([sets[i].tobytes() for i in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "tasks", "shingles"])

    sets = rows.mapInArrow(shingle, "node long, tasks array<long>, shingles binary").select(F.explode("tasks").alias("task"), "node", "shingles")
    rows = sets.repartition("task").sortWithinPartitions("task", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "task"):
            task, node, data = batch.column("task").to_numpy(), batch.column("node").to_numpy(), batch.column("shingles").to_pylist()
            edges = group_edges(task)
            src, dst, degree = [], [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo > 1:
                    links, degrees = exact_links([np.frombuffer(d, np.uint64) for d in data[lo:hi]], num, den)
                    for x, y in links:
                        src.append(node[lo + x])
                        dst.append(node[lo + y])
                        degree.append(None)
                    if links:
                        src.append(node[lo + int(degrees.argmax())])
                        dst.append(None)
                        degree.append(int(degrees.max()))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(degree, pa.int32())], ["src", "dst", "degree"])

    return rows.mapInArrow(verify, "src long, dst long, degree int")


def _pivot_tasks(apart: DataFrame, links: DataFrame, tables: Scratch) -> DataFrame:
    """(task, node): the nodes outside the largest component of each open family, in blocks that its best linked nodes visit."""
    parts = apart.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("c"))
    tops = parts.groupBy("cluster").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("all")).where(F.col("top.c") < F.col("all"))
    blocks = F.ceil((F.col("all") - F.col("top.c")) / (BLOCK - PIVOTS)).cast("int")
    tops = tables.write(tops.select("cluster", F.col("top.part").alias("main_part"), blocks.alias("blocks")), "pivot-clusters")
    rest = apart.join(tops, "cluster").where(F.col("part") != F.col("main_part"))
    rest = rest.select(F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("task"), "node")
    best = links.where("degree is not null").groupBy(F.col("src").alias("node")).agg(F.max("degree").alias("degree"))
    best = best.join(apart.select("node", "cluster"), "node")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "node"))).where(F.col("rank") <= PIVOTS)
    visits = ranked.join(tops, "cluster").select("cluster", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return rest.unionByName(visits.select(F.xxhash64("cluster", "block").alias("task"), "node")).distinct()


def groups_of(members: DataFrame, texts: DataFrame, words: int, num: int, den: int, tables: Scratch) -> DataFrame:
    """(node, component) over all links within families; ``members`` has (node, doc_id, digest, n, bytes, family, size)."""
    identity = members.select("node", "doc_id", "digest")

    def links_of(tasks: DataFrame, name: str) -> DataFrame:
        dealt = tables.write(tasks.join(identity, "node"), f"{name}-tasks")
        return tables.write(confirmed_links(texts, dealt, words, num, den), name)

    def components(*links: DataFrame) -> DataFrame:
        edges = [x.where("dst is not null").select("src", "dst") for x in links]
        joined = edges[0]
        for more in edges[1:]:
            joined = joined.unionByName(more)
        return connected_components(joined)

    def apart(found: DataFrame, name: str) -> DataFrame:
        """Large families with the components found so far, as (cluster, node, part, n, sig)."""
        rows = large.join(found, "node", "left").select(F.col("family").alias("cluster"), "node", F.coalesce("component", "node").alias("part"), "n", F.col("bytes").alias("sig"))
        return tables.write(rows, name)

    small = members.where(F.col("size") <= BLOCK).select(F.xxhash64("family").alias("task"), "node")
    large = tables.write(members.where(F.col("size") > BLOCK), "large")
    if large.isEmpty():
        return components(links_of(small, "links"))
    first = links_of(small.unionByName(sorted_runs(large)), "links")
    found = tables.write(components(first), "groups-first")
    open_ = apart(found, "apart-first")
    pivots = tables.write(_pivot_tasks(open_, first, tables), "pivots")
    if pivots.isEmpty():
        return found
    second = links_of(pivots, "pivot-links")
    found = tables.write(components(first, second), "groups-second")
    dealt = across(apart(found, "apart-second"), tables, "apart-clusters")
    tasks = tables.write(_screened(dealt, _least_equal(num / den), num, den, "task long, node long, part long", _task_members), "last-tasks")
    if tasks.isEmpty():
        return found
    third = links_of(tasks.select("task", "node"), "last-links")
    return components(first, second, third)


def near_dedup(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by shingle sets with den * |a & b| >= num * |a | b|.

    One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept (doc_id
    is component_id) and text_hash (xxhash64 of the text, to tell rows apart that repeat a doc_id).  Texts that are null, empty or without words have no shingles and are linked with nothing.
    Equal sets are linked.  A null doc_id takes no part in links: its component_id is null and it is kept.  Rows
    that repeat a doc_id are linked by their own texts only.  Other columns are not read; an empty table gives no row.
    """
    tables = Scratch(docs.sparkSession, "op2")
    sketch = tables.write(sketches(docs, id_col, text_col, words), "sketches")
    named = sketch.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n_shingles", "bytes", "labels")], F.min("doc_id").alias("doc_id"))
    nodes = tables.write(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    family = tables.write(families(forest(nodes, tables), num, den, tables), "families")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    known = nodes.select("node", "doc_id", "digest", F.col("n_shingles").alias("n"), "bytes")
    members = tables.write(family.join(sizes, "family").join(known, "node"), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    grouped = tables.write(groups_of(members, texts, words, num, den, tables), "groups").join(nodes.select("node", "digest", "doc_id"), "node")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_digest = tables.write(grouped.join(least, "component").select("digest", "component_id"), "component-ids")
    alone = nodes.select("digest", "doc_id").join(of_digest, "digest", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    labels = tables.write(alone, "labels")
    tables.close(keep=("sketches", "labels"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return sketch.join(labels, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")
