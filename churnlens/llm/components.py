"""Connected components of an edge table, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.session import materialize_at, release_materialized


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; a component's name is its smallest node.

    Each round a node takes the smallest label around it, and then that label's own label, which
    shortens chains by half.  A round is two equi-joins and one pre-aggregated minimum, written to
    the shared folder; no component is gathered in a task or the driver.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other")
    both, both_path = materialize_at(both.distinct())
    labels, path = materialize_at(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("_c")), "other").groupBy("node").agg(F.min("_c").alias("_c"))
        step = labels.join(around, "node").select("node", F.col("component").alias("_old"), F.least("component", "_c").alias("_new"))
        up = labels.select(F.col("node").alias("_new"), F.col("component").alias("_up"))
        step = step.join(up, "_new").select("node", F.least("_new", "_up").alias("component"), (F.least("_new", "_up") < F.col("_old")).alias("_moved"))
        new, new_path = materialize_at(step)
        moved = not new.where("_moved").limit(1).isEmpty()
        release_materialized(labels.sparkSession, [path])
        labels, path = new.drop("_moved"), new_path
        if not moved:
            release_materialized(labels.sparkSession, [both_path])
            return labels


def extend(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels`` (of :func:`components`) after more links: only the components that these join are worked on."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    named = labels.select("node", "component")
    left = named.withColumnsRenamed({"node": "a", "component": "_a"})
    right = named.withColumnsRenamed({"node": "b", "component": "_b"})
    between = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("_joined"))
    fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node", "left_anti")
    nodes = named.unionByName(fresh.withColumn("component", F.col("node")))
    return nodes.join(joined, "component", "left").select("node", F.coalesce("_joined", "component").alias("component"))
