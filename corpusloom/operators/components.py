"""Connected components of a graph of integer nodes, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.storage import discard, fresh_path, materialize


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that it reaches.

    Labels point from nodes to smaller nodes and form trees.  In each round a node hears the least label of its neighbours'
    labels; that value is offered to the node itself (hooking), to the node that its label names (hooking of
    the root, so that a whole tree moves at once), and every node is offered its label's label (jumping); the least offer
    stands.  A long chain with its least node at an end is done in tens of rounds, not in as many as it has
    nodes.  The first round without a change ends it.  A node's neighbours are never gathered: minima are partially
    aggregated, and lookups by label are joins whose hot keys adaptive execution can split.  Every round is
    a table in the shared folder, and tables of rounds before the last are deleted.  Edges with a null end are left out;
    repeated edges and loops change nothing; an empty table gives no row.
    """
    spark = edges.sparkSession
    ends = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    a, b = F.col(source).cast("long"), F.col(target).cast("long")
    both = ends.select(F.explode(F.array(F.struct(a.alias("node"), b.alias("other")), F.struct(b.alias("node"), a.alias("other")))).alias("e"))
    edges_path, path = fresh_path(spark, "components-edges"), fresh_path(spark, "components")
    both = materialize(both.select("e.node", "e.other").distinct(), "", edges_path)
    labels = materialize(
        both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "", path
    )
    while True:
        jumped_path, next_path = fresh_path(spark, "components"), fresh_path(spark, "components")
        owners = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialize(labels.join(owners, "label").select("node", "label", "up"), "", jumped_path)
        heard = both.join(jumped.select(F.col("node").alias("other"), "up"), "other").groupBy("node").agg(F.min("up").alias("up"))
        hooks = heard.join(jumped.select("node", "label"), "node").select(F.explode(F.array("node", "label")).alias("node"), "up")
        least = hooks.unionByName(jumped.select("node", "up")).groupBy("node").agg(F.min("up").alias("least"))
        after = jumped.join(least, "node").select("node", F.least("label", "least").alias("label"), (F.col("least") < F.col("label")).alias("fell"))
        after = materialize(after, "", next_path)
        done = after.where("fell").isEmpty()
        discard(spark, path)
        discard(spark, jumped_path)
        path, labels = next_path, after.select("node", "label")
        if done:
            discard(spark, edges_path)
            return labels.withColumnRenamed("label", "component")
