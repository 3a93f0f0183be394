"""Connected components by label propagation with pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its least node.

    In each round a node takes its least neighbour, or itself, as its parent,
    and then its parent's parent; edges are drawn between parents anew and
    those inside a component go.  Every component of the drawn graph loses
    nodes in every round, and the groups here are stars around a leader, so few
    rounds are needed.  Minima are pre-aggregated before they are shuffled, and
    what a round gives is written to the shared folder.
    """
    left = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    labels = None
    while True:
        both = left.union(left.select("v", "u"))
        parents = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("parent")), "parents")
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        parents = stored(parents.join(up, "parent").select("node", F.col("next").alias("parent")), "parents")
        to = parents.select(F.col("node").alias("component"), "parent")
        labels = parents.withColumnRenamed("parent", "component") if labels is None else labels.join(to, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = stored(labels, "labels")
        at_u, at_v = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in ("u", "v"))
        left = stored(left.join(at_u, "u").join(at_v, "v").filter("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
        if left.isEmpty():
            return labels
